"""The one row type of the library: a sequencing read."""

from pyspark.sql import types as T

READS = T.StructType(
    [
        T.StructField("input_idx", T.IntegerType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("format", T.StringType(), False),
        T.StructField("ord", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("desc", T.StringType(), True),
        T.StructField("seq", T.StringType(), False),
        T.StructField("qual", T.StringType(), True),
    ]
)
FASTQ, FASTA, BAM = "FASTQ", "FASTA", "BAM"
