"""Constants and schemas of the position table."""

from pyspark.sql import types as T

# Fixed values of the container format and its codecs.
MAGIC = b"CNN2"
VERSION = 2
HEADER_SIZE = 256
BLOCK_SIZE = 1024
MAX_COUNT = 32
COUNT_BASE = 2
FIXED_SCALE = 3000.0
NORMAL_EVAL_CLIP = 6.5
STORAGE_TARGET_CLIP = 10.0
MAX_FEATURE_ID = 768
PAD = 65535
FEATURE_SETS = {1: "HalfP", 2: "HalfKAv2_hm", 3: "HalfKA"}
FORMAT_NAME = "cnnp_sparse_v2"
LAYOUT_NAME = "single_file"
DEFAULT_METADATA = '{"format":"' + FORMAT_NAME + '","layout":"' + LAYOUT_NAME + '"}'

# Fixed values of loss, validation and schedules.
EVAL_SCALE = 400.0
FILTER_THRESHOLD, FILTER_WEIGHT, SKIP_THRESHOLD = 4.5, 0.5, 100.0
MATE_THRESHOLD, WDL_TEMPERATURE = 6.5, 350.0
BUCKET_WEIGHTS = (1.0, 1.0, 1.2, 1.5, 2.0, 2.0, 1.5, 1.0)
PHASE_WEIGHTS = {"opening": 0.05, "middle": 0.90, "endgame": 0.05}
QUALITY_PENALTY = 0.01

INPUT_POSITION = T.StructType([
    T.StructField("score_cp", T.IntegerType()), T.StructField("wdl", T.IntegerType()), T.StructField("stm", T.IntegerType()),
    T.StructField("piece_count", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType(), False)),
])
POSITION = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("flags", T.ShortType()), T.StructField("eval_raw", T.ShortType()), T.StructField("eval_norm", T.FloatType()),
    T.StructField("wdl", T.ByteType()), T.StructField("stm", T.ByteType()), T.StructField("piece_count", T.ByteType()), T.StructField("features", T.ArrayType(T.IntegerType(), False)),
])
BLOCK = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("prefix", T.ArrayType(T.IntegerType(), False))])


class ParseError(ValueError):
    """A header that breaks the format."""


class EncodeError(ValueError):
    """A value outside a codec's domain."""


class ValidationError(ValueError):
    """Data that breaks a rule of the format."""


class WriteError(ValueError):
    """Rows or options that can't be written."""
