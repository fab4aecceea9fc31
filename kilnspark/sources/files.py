"""Readers of the file layouts a corpus or run folder comes in."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kilnspark.functions import text as T


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows exists."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first path of an ordered list that exists; FileNotFoundError if none does."""
    tried = list(paths)
    for p in tried:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {tried} exists")


def first_nonempty(sources: Iterable[Callable[[], DataFrame]]) -> DataFrame | None:
    """The first source that can be read and has rows; None if there is none.  Only one row of each is looked for."""
    for make in sources:
        try:
            df = make()
            if not df.isEmpty():
                return df
        except Exception:  # noqa: BLE001  a source that can't be read counts as empty
            continue
    return None


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, fields a line lacks are null."""
    return spark.read.schema(schema).json(path)


def json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(path, key, value) of whole files that hold one JSON object by key."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return exploded_map(raw, "body", value)


def exploded_map(df: DataFrame, body: str, value: str = "string") -> DataFrame:
    """One row per key of a JSON object in column ``body``; rows that hold something else vanish."""
    return df.select(*[c for c in df.columns if c != body], F.explode(F.from_json(body, f"map<string,{value}>")).alias("key", "value"))


def merge_first(df: DataFrame, key: str, path: str, pos: str) -> DataFrame:
    """First row of each key by path, then place in the file."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(path, pos)).alias("_first")).select(key, "_first.*").select(*df.columns)


def paired_files(spark: SparkSession, folder: str, left: str, right: str) -> DataFrame:
    """(key, left text, right text) of a folder's files that differ in their suffix only, e.g. ``_prompt.txt`` and ``_ref.sv``."""

    def side(suffix: str, name: str) -> DataFrame:
        raw = spark.read.text(f"{folder}/*{suffix}", wholetext=True).select(F.input_file_name().alias("p"), F.col("value").alias(name))
        return raw.select(F.regexp_replace(T.basename(F.col("p")), rf"\Q{suffix}\E$", "").alias("key"), name)

    return side(left, "left_text").join(side(right, "right_text"), "key")


def text_by_key(df: DataFrame, path: str, text: str, suffixes: list[str], folders: list[str] | None = None) -> DataFrame:
    """(key, path, text): per key (file name without suffix) the first non-empty text in the order of folders, then of suffixes."""
    name = T.basename(F.col(path))
    rank, key = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, s in enumerate(suffixes):
        hit = F.endswith(F.lower(name), F.lit(s))
        rank = F.coalesce(rank, F.when(hit, F.lit(i)))
        key = F.coalesce(key, F.when(hit, F.expr(f"left(element_at(split({path}, '/'), -1), length(element_at(split({path}, '/'), -1)) - {len(s)})")))
    folder = F.lit(0)
    for i, f in enumerate(folders or []):
        folder = F.when(F.col(path).startswith(f), F.lit(i)).otherwise(folder if i else F.lit(len(folders)))
    rows = df.select(F.col(path).alias("path"), F.col(text).alias("text"), key.alias("key"), folder.alias("_f"), rank.alias("_s")).filter(F.col("key").isNotNull() & ~T.is_blank(F.col("text")))
    return rows.groupBy("key").agg(F.min_by(F.struct("path", "text"), F.struct("_f", "_s", "path")).alias("_first")).select("key", "_first.*")


def latest(df: DataFrame, key: str, name: str) -> DataFrame:
    """Last name of each key in sorted order."""
    return df.groupBy(key).agg(F.max(name).alias(name))


def xml_results(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of simulator result files, one row each."""
    case = "struct<_name:string,_classname:string,_time:double,_sim_time_ns:double,failure:struct<_error_type:string,_error_msg:string>>"
    raw = spark.read.format("xml").option("rowTag", "testsuite").schema(f"testcase array<{case}>").load(path)
    c = raw.select(F.explode("testcase").alias("c"))
    return c.select(
        F.col("c._name").alias("name"), F.col("c._classname").alias("classname"), F.col("c._time").alias("time_s"), F.col("c._sim_time_ns").alias("sim_time_ns"), F.col("c.failure._error_msg").alias("error_msg")
    )


def xml_failures(xml: Column) -> Column:
    """Failure messages of a result file's text, by the XML parser."""
    case = "struct<failure:struct<_error_type:string,_error_msg:string>>"
    cases = F.from_xml(xml, f"testcase array<{case}>")["testcase"]
    return F.transform(F.filter(cases, lambda c: c["failure"].isNotNull()), lambda c: c["failure"]["_error_msg"])


def folder_key(c: Column) -> Column:
    """Key of a result folder: the problem's id without its four-digit number."""
    return F.regexp_replace(c, r"_\d{4}$", "")
