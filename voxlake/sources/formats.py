"""Readers and writers of the keyed text formats: turns, scoring regions, segments, keyword hits, maps and language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''").withColumn("f", F.split("line", r"\s+"))


def _ms(c: Column) -> Column:
    return F.round(c.try_cast("double") * 1000).cast("long")


#: The type names of a turn file's lines that carry metadata other than turns.
INFO = "SPKR-INFO"


def parse_turns(lines: DataFrame) -> DataFrame:
    """(line) to (type, file_id, channel, onset_ms, offset_ms, speaker_id): nine fields or more, information lines and turns
    without duration dropped."""
    t = lines.withColumn("f", F.split(F.trim("line"), r"\s+")).filter((F.size("f") >= 9) & (F.col("f")[0] != INFO))
    on, dur = _ms(F.col("f")[3]), _ms(F.col("f")[4])
    t = t.select(F.col("f")[0].alias("type"), F.col("f")[1].alias("file_id"), F.col("f")[2].alias("channel"), on.alias("onset_ms"), (on + dur).alias("offset_ms"), F.col("f")[7].alias("speaker_id"))
    return t.filter("onset_ms >= 0 and offset_ms > onset_ms")


def read_turns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_turns(spark.read.text(path).withColumnRenamed("value", "line"))


def read_turn_list(spark: SparkSession, list_path: str) -> DataFrame:
    """All turn files that a list names, one path a line; the list is driver-side, as file names are for any reader."""
    return read_turns(spark, [r["value"].strip() for r in spark.read.text(list_path).filter("trim(value) <> ''").collect()])


def turn_lines(turns: DataFrame) -> DataFrame:
    s = lambda c: F.format_string("%.3f", F.col(c) / 1000.0)
    dur = F.format_string("%.3f", (F.col("offset_ms") - F.col("onset_ms")) / 1000.0)
    return turns.select(F.concat_ws(" ", F.lit("SPEAKER"), "file_id", F.lit("1"), s("onset_ms"), dur, F.lit("<NA>"), F.lit("<NA>"), "speaker_id", F.lit("<NA>"), F.lit("<NA>")).alias("value"))


def write_turns(turns: DataFrame, path: str) -> None:
    turn_lines(turns).write.text(path)


def turn_faults(lines: DataFrame) -> DataFrame:
    """(line, fault) for lines that are no turns."""
    f = F.split(F.trim("line"), r"\s+")
    on, dur = f[3].try_cast("double"), f[4].try_cast("double")
    fault = F.when(F.size(f) < 9, "too few fields").when(on.isNull() | dur.isNull(), "no number").when(on < 0, "negative onset").when(dur <= 0, "no duration")
    return lines.select("line", fault.alias("fault")).filter("fault is not null")


def parse_regions(lines: DataFrame) -> DataFrame:
    """(line) to (file_id, onset_ms, offset_ms): comments dropped, path and extension of the file name stripped."""
    t = lines.filter(~F.ltrim("line").startswith(";") & (F.trim("line") != "")).select(F.split(F.trim("line"), r"\s+").alias("f"))
    name = F.regexp_replace(F.regexp_replace(F.col("f")[0], "^.*/", ""), r"[.][^.]*$", "")
    return t.select(name.alias("file_id"), _ms(F.col("f")[2]).alias("onset_ms"), _ms(F.col("f")[3]).alias("offset_ms")).filter("onset_ms >= 0 and onset_ms < offset_ms")


def read_regions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_regions(spark.read.text(path).withColumnRenamed("value", "line"))


def region_lines(regions: DataFrame) -> DataFrame:
    return regions.select(F.format_string("%s 1 %.3f %.3f", "file_id", F.col("onset_ms") / 1000.0, F.col("offset_ms") / 1000.0).alias("value"))


def overlapping_regions(regions: DataFrame) -> DataFrame:
    """Regions that begin before an earlier one of their file ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("onset_ms", "offset_ms").rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("reach", F.max("offset_ms").over(w)).filter("onset_ms < reach").drop("reach")


def parse_segments(lines: DataFrame) -> DataFrame:
    t = lines.select(F.split(F.trim("line"), r"\s+").alias("f")).filter(F.size("f") == 4)
    return t.select(F.col("f")[0].alias("utt"), F.col("f")[1].alias("reco"), _ms(F.col("f")[2]).alias("start_ms"), _ms(F.col("f")[3]).alias("end_ms")).filter("start_ms < end_ms")


def read_segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_segments(spark.read.text(path).withColumnRenamed("value", "line"))


def read_domains(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(domain, uri) of a tab-separated table of recordings with a heading."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).select("domain", "uri")


def parse_models(texts: DataFrame, parts: list[str]) -> DataFrame:
    """(model, text) to (model, part, row, col, value): the bracketed vectors and matrices of models in text form, in the order of `parts`. Words outside brackets, such as tags, are no values; a vector is row 0."""
    blocks = F.slice(F.split("text", r"\["), 2, len(parts))
    t = texts.select("model", F.posexplode(blocks).alias("at", "block")).select("model", F.get(F.lit(parts), F.col("at")).alias("part"), F.split("block", r"\]")[0].alias("body"))
    lines = F.filter(F.split("body", "\n"), lambda r: F.trim(r) != "")
    rows = t.select("model", "part", F.posexplode(lines).alias("row", "line"))
    return rows.select("model", "part", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v")).select("model", "part", "row", "col", F.col("v").try_cast("double").alias("value"))


def read_models(spark: SparkSession, path: str | list[str], parts: list[str]) -> DataFrame:
    """Model files: mean, transform and between-class variances of one kind; one matrix of another. A file is one row until it is parsed: its size goes with the square of the dimensions."""
    return parse_models(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("model"), F.col("value").alias("text")), parts)


def model_arrays(model: DataFrame) -> dict:
    """Arrays by part of one model's table; its size goes with the square of the dimensions."""
    import numpy as np

    found: dict[str, dict] = {}
    for r in model.select("part", "row", "col", "value").collect():
        found.setdefault(r["part"], {})[r["row"], r["col"]] = r["value"]
    out = {}
    for part, cells in found.items():
        a = np.full((1 + max(i for i, _ in cells), 1 + max(j for _, j in cells)), np.nan)
        for (i, j), v in cells.items():
            a[i, j] = v
        if np.isnan(a).any():
            raise ValueError(f"{part} has gaps")
        out[part] = a[0] if len(a) == 1 else a
    return out


def model_text(tag: str, arrays: list) -> str:
    """Vectors and matrices between tags, all digits kept."""
    def one(a) -> str:  # noqa: ANN001
        if a.ndim == 1:
            return " [ " + " ".join(repr(float(v)) for v in a) + " ]"
        return " [\n" + "\n".join("  " + " ".join(repr(float(v)) for v in r) for r in a) + " ]"

    return f"<{tag}> " + "\n".join(map(one, arrays)) + f"\n</{tag}> "


def read_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Any keyed file: (key, rest)."""
    return _fields(spark, path).select(F.col("f")[0].alias("key"), F.slice("f", 2, F.size("f") - 1).alias("rest"))


def parse_word_map(lines: DataFrame) -> DataFrame:
    """'a => b' lines to (token, image); comments after ;; dropped."""
    t = lines.select(F.regexp_replace("line", ";;.*$", "").alias("l")).filter(F.instr("l", "=>") > 0)
    return t.select(F.trim(F.split("l", "=>")[0]).alias("token"), F.trim(F.split("l", "=>")[1]).alias("image"))


def parse_range(suffix: Column) -> Column:
    """'file[0:9,3:5]' to a struct of file and row and column bounds."""
    g = lambda i: F.nullif(F.regexp_extract(suffix, r"^([^\[]*)(?:\[([0-9]*):?([0-9]*)(?:,([0-9]*):?([0-9]*))?\])?$", i), F.lit("")).cast("long")
    return F.struct(F.regexp_extract(suffix, r"^([^\[]*)", 1).alias("file"), g(2).alias("row_lo"), g(3).alias("row_hi"), g(4).alias("col_lo"), g(5).alias("col_hi"))


def compose_range(outer: Column, inner: Column) -> Column:
    """Rows of an inner range taken inside an outer one, clamped to it."""
    base = F.coalesce(outer["row_lo"], F.lit(0))
    hi = F.coalesce(outer["row_hi"], F.lit((1 << 31) - 1))
    return F.struct(outer["file"].alias("file"), F.least(hi, base + F.coalesce(inner["row_lo"], F.lit(0))).alias("row_lo"), F.least(hi, base + F.coalesce(inner["row_hi"], F.lit((1 << 31) - 1))).alias("row_hi"))


def write_labels(rows: DataFrame, path: str) -> None:
    """utt and its labels, blank-separated."""
    rows.select(F.concat_ws(" ", "utt", "labels").alias("value")).write.text(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """Keyword hits as XML rows."""
    hits.write.format("xml").option("rootTag", "kwslist").option("rowTag", "kw").save(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "kw").schema("kwid string, utt string, tbeg double, dur double, score double").load(path)


def parse_arpa(lines: DataFrame) -> DataFrame:
    """(number, line) of a language model file to (n, logp, ngram, bow). The section of a line is the last heading before it; headings, a few for each order, are
    an array that every line looks up."""
    head = F.regexp_extract("line", r"^\\([0-9]+)-grams:", 1)
    t = lines.withColumn("h", F.when(head != "", head.cast("int")).when(F.col("line").startswith("\\"), 0))
    heads = t.filter("h is not null").agg(F.array_sort(F.collect_list(F.struct("number", "h"))).alias("heads"))
    t = t.join(F.broadcast(heads)).withColumn("n", F.try_element_at(F.filter("heads", lambda x: x["number"] <= F.col("number")), F.lit(-1))["h"])
    t = t.filter((F.col("n") > 0) & F.col("h").isNull() & (F.trim("line") != "")).withColumn("f", F.split(F.trim("line"), r"\s+"))
    bow = F.when(F.size("f") > F.col("n") + 1, F.get("f", F.col("n") + 1).try_cast("double"))
    return t.select("n", F.col("f")[0].cast("double").alias("logp"), F.array_join(F.slice("f", 2, F.col("n")), " ").alias("ngram"), bow.alias("bow"))


def arpa_lines(model: DataFrame) -> DataFrame:
    """Sections in order: (n, place, line) of a model (n, logp, ngram, bow)."""
    body = model.select("n", F.lit(1).alias("place"), F.concat_ws("\t", F.format_string("%.6f", "logp"), "ngram", F.when(F.col("bow").isNotNull(), F.format_string("%.6f", "bow"))).alias("line"))
    head = model.groupBy("n").count().select("n", F.lit(0).alias("place"), F.format_string("\\%d-grams:", "n").alias("line"))
    counts = model.groupBy("n").count().select(F.lit(0).alias("n"), F.col("n").alias("place"), F.format_string("ngram %d=%d", "n", "count").alias("line"))
    return counts.unionByName(head).unionByName(body)


def scan_metrics(lines: DataFrame, pattern: str, group: str) -> DataFrame:
    """Numbers by regular expression from log lines, with the best (least) per group."""
    v = F.regexp_extract("line", pattern, 1)
    t = lines.filter(v != "").select(group, v.cast("double").alias("value"))
    return t.groupBy(group).agg(F.count("*").alias("n"), F.min("value").alias("best"), F.round(F.avg("value"), 6).alias("mean"))


def log_rollup(lines: DataFrame, category: str) -> DataFrame:
    """Warnings, errors and accounted seconds per category."""
    sec = F.regexp_extract("line", r"time=([0-9.]+)", 1)
    return lines.groupBy(category).agg(
        F.sum(F.when(F.col("line").contains("WARNING"), 1).otherwise(0)).alias("warnings"), F.sum(F.when(F.col("line").contains("ERROR"), 1).otherwise(0)).alias("errors"),
        F.round(F.sum(F.when(sec != "", sec.cast("double")).otherwise(0.0)), 3).alias("seconds"),
    )
