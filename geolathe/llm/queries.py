"""The queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolathe.llm import abuse, mixing, mojibake, packing, tokens
from geolathe.session import table, written

Query = Callable[[SparkSession, str], DataFrame]

NAMES = {"adm_units": ["adm1_name", "adm2_name"], "city_limits": ["city_name"]}


def _restored(spark: SparkSession, root: str) -> DataFrame:
    layers = {name: table(spark, root, name) for name in NAMES}
    values = [layers[name].select(F.explode(F.array(*cols)).alias("v")) for name, cols in NAMES.items()]
    model = mojibake.fit(mojibake.sample(values[0].unionByName(values[1]), ["v"]))
    parts = [mojibake.restored(layers[name], "fid", cols, model).select(F.lit(name).alias("layer"), "*") for name, cols in NAMES.items()]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _restored(spark, root).select("layer", "fid", "field")


def p1_restored(spark: SparkSession, root: str) -> DataFrame:
    return _restored(spark, root)


def _capacity(spark: SparkSession, root: str) -> int:
    return int(table(spark, root, "pack_bins").agg(F.max("capacity_tokens")).first()[0])


def _packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.packed_texts(table(spark, root, "documents"), "doc_id", "text", _capacity(spark, root), tokens.TOKENIZER)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages that were split: the packing gives them more than one piece."""
    return _packing(spark, root).where(F.col("piece_no") == 1).select("doc_id")


def p6_packing(spark: SparkSession, root: str) -> DataFrame:
    return _packing(spark, root)


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(_packing(spark, root), _capacity(spark, root))


def _sized(spark: SparkSession, root: str) -> DataFrame:
    return written(tokens.counted(table(spark, root, "documents"), ["doc_id", "source"], "text"), "sized")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    shares = mixing.mix_plan(_sized(spark, root), "source", "n_tokens", table(spark, root, "mix_targets"))
    return spark.createDataFrame([(s.source,) for s in shares if not s.reachable], "source string")


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    sized = _sized(spark, root)
    return mixing.mixed(sized, "doc_id", "source", "n_tokens", mixing.mix_plan(sized, "source", "n_tokens", table(spark, root, "mix_targets")))


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    sized = _sized(spark, root)
    shares = mixing.mix_plan(sized, "source", "n_tokens", table(spark, root, "mix_targets"))
    return mixing.mix_report(mixing.mixed(sized, "doc_id", "source", "n_tokens", shares), "source", "n_tokens", shares)


def _scores(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    columns = F.col("line_boxes.col_no")
    return abuse.judged(docs, table(spark, root, "abuse_labels"), "doc_id", ["doc_id", "source"], "text", columns)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _scores(spark, root).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    return _scores(spark, root)


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    return abuse.rates(_scores(spark, root), "source")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_restored, p6_found, p6_packing, p6_report, p7_found, p7_mix, p7_report, p8_found, p8_scores, p8_rates)}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, trained classifiers and seeded samples have no SQL; their tests are in tests/llm."""
    return {}
