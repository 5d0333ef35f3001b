"""They must equal the established file and column conventions."""

# Mask and output file suffixes, by role.
SUFFIXES = {
    "axonmyelin": "_seg-axonmyelin.png",
    "axon": "_seg-axon.png",
    "myelin": "_seg-myelin.png",
    "index": "_index.png",
    "axonmyelin_index": "_axonmyelin_index.png",
    "uaxon": "_seg-uaxon.png",
    "uaxon_index": "_uaxon_index.png",
    "nnunet": "_seg-nnunet.png",
    "nerve": "_seg-nerve.png",
    "nerve_index": "_nerve_index.png",
    "diameter_overlay": "_diameter_overlay.png",
    "morph": "axon_morphometrics.xlsx",
    "morph_agg": "subject_morphometrics.xlsx",
    "uaxon_morph": "uaxon_morphometrics.xlsx",
    "nerve_morph": "nerve_morphometrics.json",
    "instance_colour": "_colorized.png",
    "instance_map": "_instance-map.png",
}

# Readable image extensions, longest match first.
VALID_EXTENSIONS = [
    ".ome.tif", ".ome.tiff", ".ome.tf2", ".ome.tf8", ".ome.btf",
    ".tif", ".tiff", ".png", ".jpg", ".jpeg",
]

# Pixel intensities of a semantic mask.
INTENSITY = {"binary": 255, "axon": 255, "myelin": 127, "background": 0}

# Object columns in output order with their display names.
DISPLAY_NAMES = {
    "x0": "x0 (px)",
    "y0": "y0 (px)",
    "gratio": "gratio",
    "axon_area": "axon_area (um^2)",
    "axon_perimeter": "axon_perimeter (um)",
    "myelin_area": "myelin_area (um^2)",
    "axon_diam": "axon_diam (um)",
    "myelin_thickness": "myelin_thickness (um)",
    "axonmyelin_area": "axonmyelin_area (um^2)",
    "axonmyelin_perimeter": "axonmyelin_perimeter (um)",
    "eccentricity": "eccentricity",
    "orientation": "orientation",
    "fiber_eccentricity": "fiber_eccentricity",
    "fiber_orientation": "fiber_orientation",
}

# Diameter bins (lower bound inclusive) and the metrics they split.
DIAMETER_BINS = [
    ("0.5-1", 0.5, 1.0),
    ("1-1.25", 1.0, 1.25),
    ("1.25-1.5", 1.25, 1.5),
    ("1.5-1.75", 1.5, 1.75),
    ("1.75-", 1.75, None),
]
BINNED_METRICS = {
    "Axon Diameter": "axon_diam",
    "G-Ratio": "gratio",
    "Myelin Thickness": "myelin_thickness",
}

# Default colour palette for instance maps.
PALETTE = [(217, 237, 146), (118, 200, 147), (22, 138, 173), (24, 78, 119)]

# Size limits in pixels (slow, ordinary and opted-in).
SLOW_PIXELS = 25_000_000
PIXEL_LIMIT = 89_478_485
LARGE_PIXEL_LIMIT = 1_000_000_000

PIXEL_SIZE_FILE = "pixel_size_in_micrometer.txt"
AGGREGATE_DIR = "morphometrics_agg"
