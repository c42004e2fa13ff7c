"""Constants of the frame pipeline."""

# Results depend on these exact numbers.
SCAN_FPS = 20
LEGACY_FPS = 2
PREVIEW_SECONDS = 30.0
PREVIEW_POSITION = 0.5
PROBE_POSITIONS = (0.2, 0.4, 0.6, 0.8)
PROGRESS_SECONDS = 8
LEGACY_PROGRESS_SECONDS = 10
CONTENT_MIN = 0.004
DEFAULT_ROI = (0.70, 1.00, 0.00, 1.00)
MIN_BOX = 20

BAND_RATIO = 0.15
BAND_MIN = 8
SECOND_BAND_RATIO = 0.30
MIN_SHIFT = 4
MIN_SCORE = 0.40
MARGIN = 0.15
DX_AGREE_TOL = 6
SEED_REFRESH_SCORE = 0.70
NEWPAGE_MAX_SCORE = 0.30
STABLE_SCORE = 0.75
SAME_PAGE_SCORE = 0.62
STABLE_PAGE_SCORE = 0.90

POLARITY_TRANSLUCENT = 100
POLARITY_OPAQUE = 110
POLARITY_TEXT = 128
BLACKHAT_SIZE = 9
ADAPTIVE_BLOCK = 31
ADAPTIVE_C = 12
FIXED_LEVEL = 200
LINE_MIN = 15
LINE_DIVISOR = 3
GAIN = 3
NOISE_FLOOR = 45
NOISE_MIN_AREA = 8
DIFF_LEVEL = 20
CLAHE_CLIP = 2.0
CLAHE_GRID = 8

CHANGE_RATIO = 0.02
STABLE_RATIO = 0.015
STABLE_COUNT = 2
MEASURES_PER_BLOCK = 4
OVERLAP_BAND = 80
OVERLAP_OFFSET = 50
OVERLAP_SCORE = 0.7
BAR_TARGET = 0.85
BAR_RANGE = 60
BAR_FRACTION = 0.7
CAPTURE_FRACTION = 0.4
FLUSH_MIN = 50

CHUNK_MIN = 40
PAGE_W = 595.28
PAGE_H = 841.89
PAGE_MARGIN = 20.0
PAGE_GAP = 25.0

UNIFORM_STDDEV = 8
BLANK_FRACTION = 0.005
TEXT_HEIGHT = 120
TEXT_MIN_W = 10
TEXT_MAX_W = 2000
TITLE_MAX = 50

TITLE_DROP = r"[^a-zA-Z0-9가-힣_\- ]"
NAME_FORBIDDEN = r'[\\/:*?"<>|\x00-\x1F]'
NAME_TAIL = r"[ .]+$"
PDF_SUFFIX = r"(?i)\.pdf$"
STANDALONE_NUMBER = r"(?<![0-9A-Za-z_])([1-9][0-9]{0,3})(?![0-9A-Za-z_])"
CAPTURE_PREFIX = "FRAME_SAVED:"
CHUNK_NAME = "frame_%04d.jpg"
SHEET_NAME = "sheet_%02d"
VIDEO_FILE = r"^video.*\.(mp4|mkv|webm)$"

# Tuning of the Spark side; results do not depend on these.
SEGMENT_ROWS = 512          # rows of one sequence handled by one task of a fold
NUMBERING_SPAN = 1 << 16    # width of an id bucket when numbering rows
VECTOR_SPAN = 512           # same for vectors, which unfold to many pixels each
DAY_US = 86_400_000_000     # width of a time bucket when numbering events
TILE_COLUMNS = 256          # panorama columns handled together
