"""Readers, writers and column codecs.

Paths are Hadoop paths (local, HDFS, object stores); discovery uses the
Hadoop FileSystem of the session, so the driver only lists metadata.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# FIXED VALUES: names a training folder is searched for, in order, and the separator by suffix (separator_for).
TRAIN_NAMES = ["train.csv", "train.tsv", "training.csv", "training.tsv"]
VALIDATION_NAMES = ["val.csv", "val.tsv", "validation.csv", "validation.tsv", "dev.csv", "dev.tsv"]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that the caller wrote, if it is there."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def separator_for(path: str) -> str:
    """A2: ``.tsv``/``.txt`` -> tab, anything else -> comma."""
    ext = posixpath.splitext(path.lower())[1]
    return "\t" if ext in (".tsv", ".txt") else ","


REJECT = "_rejected_record"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   multi_line: bool = False, rejects: bool = False) -> DataFrame:
    """A2: header row, separator by extension; no schema inference on a cluster
    unless no schema is given.

    ``multi_line`` is for quoted line breaks: it makes every file one task, so
    such tables should come in many files. Without it a record that a line break
    cuts has too few columns; records that do not fit the schema are an error
    unless ``rejects`` keeps them, whole, in the column ``_rejected_record`` (null
    for all others). The tail of a cut record can fit the schema by chance, so
    tables with line breaks in texts are to be read with ``multi_line``.
    """
    r = spark.read.option("header", True).option("sep", separator_for(path)).option("multiLine", multi_line) \
        .option("escape", '"').option("enforceSchema", False)
    if schema is None:
        return r.option("inferSchema", True).csv(path)
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not rejects:
        return r.schema(fields).option("mode", "FAILFAST").csv(path)
    return (r.option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECT)
            .schema(T.StructType([*fields.fields, T.StructField(REJECT, T.StringType())])).csv(path))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows read with ``rejects``: the good ones, and the rejected records as (record)."""
    return (df.where(F.col(REJECT).isNull()).drop(REJECT),
            df.where(F.col(REJECT).isNotNull()).select(F.col(REJECT).alias("record")))


def pick_existing(spark: SparkSession, base: str, candidates: list[str]) -> str | None:
    """A3: first candidate that exists under ``base``."""
    for name in candidates:
        p = posixpath.join(base, name)
        if path_exists(spark, p):
            return p
    return None


def read_splits(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False,
                rejects: bool = False) -> DataFrame:
    """A2, A3: the train and the validation file of a folder with ``split`` ('train' / 'validation'), or a single file without."""
    if is_dir(spark, path):
        tr = pick_existing(spark, path, TRAIN_NAMES)
        va = pick_existing(spark, path, VALIDATION_NAMES)
        if not tr or not va:
            raise ValueError(f"{path} holds no training file or no validation file")
        a, b = (read_delimited(spark, p, schema, multi_line, rejects).withColumn("split", F.lit(n))
                for p, n in ((tr, "train"), (va, "validation")))
        return a.unionByName(b)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    return read_delimited(spark, path, schema, multi_line, rejects)


def load_training_data(spark: SparkSession, path: str, text_col: str, label_cols: list[str],
                       seed: int = 42, test_pct: int = 20, schema: T.StructType | str | None = None,
                       multi_line: bool = False, keep_missing: bool = False) -> DataFrame:
    """A2-A5: a labelled table tagged with ``split`` ('train' / 'validation').

    A directory must hold a train and a validation file (first existing
    name of each list); a single file is split by a stable hash (A5). An empty
    field is a missing text, quoted or not, and its row is left out unless
    ``keep_missing`` returns it with a null text. Without a ``schema`` the files are read twice, once to infer it. Records that do not
    fit the schema are an error; :func:`load_with_rejects` keeps them aside.
    """
    rows = _training_rows(read_splits(spark, path, schema, multi_line), text_col, label_cols, seed, test_pct)
    return rows if keep_missing else rows.where(F.col("text").isNotNull())


def load_with_rejects(spark: SparkSession, path: str, text_col: str, label_cols: list[str], schema: T.StructType | str,
                      seed: int = 42, test_pct: int = 20, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """As :func:`load_training_data`, and (record, reason) of what is not in it: broken records and missing texts.

    The files are parsed once, into the shared folder; both results read that.
    """
    from ..session import materialize

    rows = materialize(read_splits(spark, path, schema, multi_line, rejects=True), "parsed")
    good, broken = split_rejects(rows)
    missing = good.where(F.col(text_col).isNull()).select(F.to_csv(F.struct(*good.columns)).alias("record"),
                                                          F.lit("missing text").alias("reason"))
    return (_training_rows(good, text_col, label_cols, seed, test_pct).where(F.col("text").isNotNull()),
            broken.withColumn("reason", F.lit("broken record")).unionByName(missing))


def _training_rows(rows: DataFrame, text_col: str, label_cols: list[str], seed: int, test_pct: int) -> DataFrame:
    from ..operators.metrics import holdout_flag

    split = F.col("split") if "split" in rows.columns else F.when(
        holdout_flag(F.col(text_col).cast("string"), seed, test_pct), "validation").otherwise("train")
    return rows.select(F.col(text_col).cast("string").alias("text"), F.array(
        *[F.col(c).cast("float") for c in label_cols]).alias("labels"), split.alias("split"))


# ------------------------------------------------------------------ A8 JSON columns

def json_counts(keys: list[str], counts: list[Column], order: list[Column] | None = None,
                descending: bool = False) -> Column:
    """Encode non-zero counts as ``json.dumps`` does: ``{"k": n, "k2": m}``.

    ``order`` (one Column per key) fixes the key order, e.g. the first-met
    order of the buckets (newest row first: ``descending=True``).
    """
    items = [F.struct((order[i] if order else F.lit(i)).alias("o"), F.lit(k).alias("k"), counts[i].alias("v"))
             for i, k in enumerate(keys)]
    sign = -1 if descending else 1
    nz = F.array_sort(F.filter(F.array(*items), lambda x: x["v"] > 0),
                      lambda a, b: F.when(a["o"] < b["o"], -sign).when(a["o"] > b["o"], sign).otherwise(0))
    body = F.array_join(F.transform(nz, lambda x: F.format_string('"%s": %d', x["k"], x["v"])), ", ")
    return F.concat(F.lit("{"), body, F.lit("}"))


def decode_json_map(col: Column, value_type: str = "bigint") -> Column:
    """Tolerant decode: malformed or NULL JSON gives an empty map."""
    m = F.from_json(col, f"map<string,{value_type}>", {"mode": "PERMISSIVE"})
    return F.coalesce(m, F.create_map().cast(f"map<string,{value_type}>"))


# ------------------------------------------------------------------ A9 column protection

def encrypt_text(col: Column, key: Column) -> Column:
    """Encrypt non-empty text (AES-GCM, base64 token); empty / NULL pass through."""
    c = col
    return F.when(c.isNull() | (c == ""), c).otherwise(F.base64(F.aes_encrypt(c, key, F.lit("GCM"))))


def decrypt_text(col: Column, key: Column) -> Column:
    """Decrypt, or return the stored value unchanged when it is not a valid token."""
    dec = F.try_aes_decrypt(F.try_to_binary(col, F.lit("base64")), key, F.lit("GCM")).cast("string")
    return F.when(col.isNull() | (col == ""), col).otherwise(F.coalesce(dec, col))


# ------------------------------------------------------------------ A10 schema evolution

ANALYSIS_ADDED = [("scores", T.MapType(T.StringType(), T.DoubleType())), ("task_type", T.StringType())]


def ensure_analysis_columns(df: DataFrame) -> DataFrame:
    """Add the nullable ``scores`` / ``task_type`` columns when a table predates them."""
    for name, dtype in ANALYSIS_ADDED:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df


def read_evolving(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet read across files written before and after a column was added."""
    return spark.read.option("mergeSchema", True).parquet(*paths)
