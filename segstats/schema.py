"""Fixed schemas (rasters are described by column contracts, see README)."""

from pyspark.sql import types as T

_DOUBLES = [
    "x0", "y0", "axon_diam", "axon_area", "axon_perimeter", "solidity", "eccentricity",
    "orientation", "fiber_orientation", "fiber_eccentricity", "gratio", "myelin_thickness",
    "myelin_area", "axonmyelin_area", "axonmyelin_perimeter",
]
_BBOX = ["bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x"]

OBJECT_MEASURES = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in _DOUBLES]
    + [T.StructField("image_border_touching", T.BooleanType())]
    + [T.StructField(c, T.IntegerType()) for c in _BBOX]
)

OBJECTS = T.StructType(
    [T.StructField("image_id", T.StringType()), T.StructField("label", T.LongType())]
    + OBJECT_MEASURES.fields
)

_MEASURE = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())])
_FASCICLE = T.StructType(_MEASURE.fields + [T.StructField("axon_density", _MEASURE)])

NERVE = T.StructType(
    [
        T.StructField("fascicle_areas", T.MapType(T.StringType(), _FASCICLE)),
        T.StructField("total_area", _MEASURE),
        T.StructField("total_axon_density", _MEASURE),
    ]
)
