"""Explicit schemas of the relations."""

FRAMES = "frame_id long, ts timestamp, w int, h int, raw binary"
PIXELS = "frame_id long, y int, x int, r int, g int, b int"
BLOCKS = "frame_id long, brow int, bcol int, bg int, fg int, mask array<long>"
RUNS = "frame_id long, run_id long, y int, x1 int, x2 int, value int"
RECTS = "frame_id long, x int, y int, w int, h int, value int"
REGIONS = "frame_id long, region_id long, minx int, miny int, maxx int, maxy int, cnt long"
TEMPLATES = "template_no int, ch string, bits array<int>"
