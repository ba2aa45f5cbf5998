"""Landed files: fixed-width indexes, column-oriented JSON, nested facts, filing texts; and datasets with provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import normalize_key

# Fixed value: a row of the index, whose company number may stand at either end of its field.
_ROW = r"^(.{12})(.{62})\s*(\d+)\s+(\d{4}-\d{2}-\d{2})\s+(\S+)"
FACTS = "struct<cik:string, facts:struct<`us-gaap`:map<string, struct<units:map<string, array<struct<val:double, fy:int, fp:string, form:string, filed:string, `end`:string>>>>>>>"


def parse_index_lines(lines: DataFrame, file: str = "file", keep: bool = False) -> DataFrame:
    """Rows of fixed-width filing indexes from their lines (value, and ``file`` that names a line's file).

    Lines that aren't rows, the preamble among them, and rows with bad dates go; so do all lines of a file without a
    header line. With ``keep`` rows have ``file`` as well.
    """
    part = lambda i: F.trim(F.regexp_extract("value", _ROW, i))
    headed = lines.where(F.contains("value", F.lit("Form Type")) & F.contains("value", F.lit("CIK"))).select(file).distinct()
    rows = lines.where(F.col("value").rlike(_ROW)).join(headed, file, "left_semi")
    rows = rows.select(*([file] if keep else []), part(1).alias("form_type"), part(2).alias("company_name"), normalize_key(part(3)).alias("cik"), F.try_to_date(part(4), "yyyy-MM-dd").alias("date_filed"), part(5).alias("filename"))
    return rows.where("date_filed is not null")


def read_index_quarters(spark: SparkSession, root: str, first_year: int, last_year: int, forms: Sequence[str] | None = None) -> DataFrame:
    """Rows of the filing indexes below ``root``, a folder ``year=Y/quarter=Q`` of text files each, for a range of years, with year and quarter.

    Only the folders of these years are read; a quarter that isn't there is passed over, and FileNotFoundError tells that
    none is. Rows of other forms than ``forms`` go.
    """
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/year=*/quarter=*")
    listed = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []
    years = {int(s.getPath().getParent().getName().split("=")[1]) for s in listed}
    if not any(first_year <= y <= last_year for y in years):
        raise FileNotFoundError(f"no filing index of {first_year} to {last_year} in {root}")
    lines = spark.read.schema("value string, year int, quarter int").text(root).where(F.col("year").between(first_year, last_year))
    rows = parse_index_lines(lines.select("value", F.concat_ws("-", "year", "quarter").alias("file")), keep=True)
    rows = rows.select("*", F.split("file", "-")[0].cast("int").alias("year"), F.split("file", "-")[1].cast("int").alias("quarter")).drop("file")
    return filter_forms(rows, forms) if forms else rows


def filter_forms(filings: DataFrame, forms: Sequence[str]) -> DataFrame:
    return filings.where(F.trim("form_type").isin(list(forms)))


def parse_column_json(docs: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """Documents {fields: [...], data: [[...], ...]} as rows with the named fields; a field that a document lacks is NULL."""
    doc = F.from_json(column, "struct<fields:array<string>, data:array<array<string>>>")
    rows = docs.select(doc.alias("d")).select("d.fields", F.explode("d.data").alias("row"))
    place = lambda f: F.array_position("fields", f).cast("int")
    return rows.select(*(F.get("row", place(f) - 1).alias(f) for f in fields))


def explode_facts(docs: DataFrame, column: str) -> DataFrame:
    """Nested fact documents as (cik, tag, unit, pos, val, fy, fp, form, filed, period_end)."""
    d = docs.select(F.from_json(column, FACTS).alias("d")).select(normalize_key(F.col("d.cik")).alias("cik"), F.explode(F.col("d.facts")["us-gaap"]).alias("tag", "t"))
    u = d.select("cik", "tag", F.explode("t.units").alias("unit", "entries"))
    return u.select("cik", "tag", "unit", F.posexplode("entries").alias("pos", "e")).select("cik", "tag", "unit", "pos", "e.val", "e.fy", "e.fp", "e.form", F.try_to_date("e.filed", "yyyy-MM-dd").alias("filed"), F.try_to_date("e.end", "yyyy-MM-dd").alias("period_end"))


def tag_phrases(docs: DataFrame, rules: DataFrame, key: str, text: str, form: str | None = None) -> DataFrame:
    """(key, rule, tier): the rules (rule, phrases, tier) whose phrases all occur in the lower-cased text. The rules are a short list of the caller's, collected and tested in one pass.

    With ``form``, the column of a document's form, a rule that names ``forms`` holds only for documents of one of these.
    """
    found = []
    for r in rules.collect():
        every = F.lit(True)
        if form is not None and "forms" in rules.columns and r.forms is not None:
            every = F.coalesce(F.trim(F.col("__form")).isin(list(r.forms)), F.lit(False))
        for p in r.phrases:
            every = every & F.contains(F.col("__low"), F.lit(p.lower()))
        found.append(F.when(every, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.tier).alias("tier"))))
    low = docs.select(key, F.lower(text).alias("__low"), (F.col(form) if form else F.lit(None).cast("string")).alias("__form"))
    return low.select(key, F.explode(F.array_compact(F.array(*found))).alias("hit")).select(key, "hit.*")


def write_with_provenance(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """The dataset, and one JSON row beside it."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([tuple(provenance.values())], list(provenance)).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_provenance")


def read_with_provenance(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The dataset and its provenance, empty where there is none."""
    df = spark.read.parquet(path)
    where = f"{path.rstrip('/')}_provenance"
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return df, {}
    return df, spark.read.json(where).first().asDict()


def parse_submissions(docs: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """The company number and the named text fields of each submissions document; empty texts are NULL."""
    d = docs.select(F.from_json(column, ", ".join(f"`{f}` string" for f in ("cik", *fields))).alias("d"))
    return d.select(normalize_key(F.col("d.cik")).alias("cik"), *(F.nullif(F.col("d")[f], F.lit("")).alias(f) for f in fields))
