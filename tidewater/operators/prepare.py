"""Dataset generators: needles at a depth, facts among background sentences, rendered conversations, joined documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import sentences
from tidewater.functions.tokens import count, pieces


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with its named places filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def assigned(names: list[str], first: Column, second: Column) -> Column:
    """A name by position, so that reruns give the same."""
    return F.get(F.array(*map(F.lit, names)), F.pmod(first + second, F.lit(len(names))).cast("int"))


def place_needles(docs: DataFrame, needle: Column, depths: list[float]) -> DataFrame:
    """``doc_id, depth, position, context, char_start, char_end``: the needle as a sentence at each depth, after at least one sentence."""
    rows = docs.select("doc_id", sentences(F.col("text")).alias("s"), needle.alias("needle")).withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    at = F.greatest(F.lit(1), F.floor(F.size("s") * F.col("depth")).cast("int"))
    before = F.concat(F.array_join(F.slice("s", F.lit(1), F.col("position")), " "), F.lit(" "))
    after = F.array_join(F.slice("s", F.col("position") + 1, F.greatest(F.size("s") - F.col("position"), F.lit(0))), " ")
    rows = rows.withColumn("position", at).withColumn("before", before)
    return rows.select("doc_id", "depth", "position", F.concat("before", "needle", F.when(after != "", F.concat(F.lit(" "), after)).otherwise("")).alias("context"), F.length("before").alias("char_start"), (F.length("before") + F.length("needle")).alias("char_end"))


def inject_facts(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """``doc_id, ord, kind, text, token_start, token_end``: facts (doc_id, position, fact) before the sentence of that position."""
    background = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("position", "text")).select("doc_id", "position", F.lit(1).alias("kind"), F.lit(0).alias("k"), "text")
    rows = background.unionByName(facts.select("doc_id", "position", F.lit(0).alias("kind"), "k", F.col("fact").alias("text")))
    order = Window.partitionBy("doc_id").orderBy("position", "kind", "k")
    rows = rows.withColumn("n", count(F.col("text"))).withColumn("ord", F.row_number().over(order)).withColumn("token_end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("doc_id", "ord", "kind", "text", (F.col("token_end") - F.col("n")).alias("token_start"), "token_end")


def running_sum(rows: DataFrame, key: str, place: str, within: list[str], value: str, block: int = 1 << 16) -> DataFrame:
    """Adds ``running``: the sum of ``value`` up to each row of a key, in the order of the number ``place`` and then of ``within``.

    A key can hold a third of all rows, so no window takes all of it: sums run within blocks of places, and sums of blocks, of
    which there are few, run over the key.
    """
    rows = rows.withColumn("block", F.floor(F.col(place) / block))
    blocks = rows.groupBy(key, "block").agg(F.sum(value).alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(key, "block", before.alias("before"))
    here = F.sum(value).over(Window.partitionBy(key, "block").orderBy(place, *within).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(blocks, [key, "block"]).withColumn("running", F.col("before") + here).drop("before", "block")


def background(docs: DataFrame, key: str, tokens: int, least: int = 3, block: int = 1 << 16) -> DataFrame:
    """Sentences of a key's texts, in order, up to a size; shorter ones than ``least`` are passed over."""
    rows = docs.select(key, "doc_id", F.posexplode(sentences(F.col("text"))).alias("position", "sentence")).withColumn("n", count(F.col("sentence"))).where(F.col("n") >= least)
    return running_sum(rows, key, "doc_id", ["position"], "n", block).withColumnRenamed("running", "used").where(F.col("used") <= tokens)


def parse_facts(texts: DataFrame) -> DataFrame:
    """``doc_id, line_no, number, phrase, answer, support`` of task files: ``12 phrase`` or ``12 question<tab>answer<tab>facts``."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike("^[0-9]+ "))
    parts = F.split(F.regexp_replace("line", "^[0-9]+ ", ""), "\t", -1)
    rows = lines.select("doc_id", "line_no", F.regexp_extract("line", "^([0-9]+) ", 1).cast("int").alias("number"), parts.alias("parts"))
    support = F.transform(F.filter(F.split(F.coalesce(F.get("parts", F.lit(2)), F.lit("")), " +"), lambda x: x != ""), lambda x: x.cast("int"))
    return rows.select("doc_id", "line_no", "number", F.trim(F.get("parts", F.lit(0))).alias("phrase"), F.get("parts", F.lit(1)).alias("answer"), support.alias("support"))


def cohort(rows: DataFrame, least_tokens: int) -> DataFrame:
    """``doc_id, n_tokens`` of contexts (doc_id, context, facts: text, token_start, token_end) that are long enough and whose facts all stand where they should."""
    rows = rows.withColumn("p", pieces(F.col("context"))).where(F.size("p") > least_tokens)
    there = lambda x: F.trim(F.array_join(F.slice("p", x["token_start"] + 1, x["token_end"] - x["token_start"]), "")) == F.trim(x["text"])
    return rows.where(F.forall("facts", there)).select("doc_id", F.size("p").alias("n_tokens"))


def review_packets(candidates: DataFrame, docs: DataFrame, around: int) -> DataFrame:
    """Candidate lines (doc_id, line_number, char_start, line) with ``around`` characters of text on either side, for a reviewer."""
    rows = candidates.join(docs.select("doc_id", "text"), "doc_id")
    start = F.greatest(F.col("char_start") - around, F.lit(0)).cast("int")
    end = F.least(F.col("char_start") + F.length("line") + around, F.length("text")).cast("int")
    return rows.select("doc_id", "line_number", "line", F.substring(F.col("text"), start + 1, end - start).alias("shown"))


def by_type(kind: Column, name: Column, text: Column) -> Column:
    """A document under its title line, as its type has it; another type raises."""
    return (
        F.when(kind == "financial", F.concat(F.lit("Report of "), name, F.lit("\n"), text))
        .when(kind == "paper", F.concat(F.lit("# "), name, F.lit("\n\n"), text))
        .when(kind == "legal", F.concat(F.lit("Case "), name, F.lit(":\n"), text))
        .otherwise(F.raise_error(F.concat(F.lit("no title line for "), F.coalesce(kind, F.lit("null")))).cast("string"))
    )


def render_turns(turns: DataFrame, user_only: bool, as_json: bool, latest: int) -> DataFrame:
    """``conv_id, history`` of the latest turns, all or the user's alone, as lines or as JSON, in order."""
    rows = turns.where("role = 'user'") if user_only else turns
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("r") <= latest)
    line = F.to_json(F.struct("role", F.col("text").alias("content"))) if as_json else F.concat("role", F.lit(": "), "text")
    kept = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return kept.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("history"))


def render_history(turns: DataFrame) -> DataFrame:
    """``conv_id, history`` and each turn's characters in it: sessions of two turns under neutral headers, then ``role: text`` lines."""
    head = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Session "), (F.floor(F.col("turn") / 2) + 1).cast("string"), F.lit("\n"))).otherwise("")
    rows = turns.withColumn("line", F.concat(head, "role", F.lit(": "), "text", F.lit("\n"))).withColumn("lead", F.length(head) + F.length("role") + 2)
    total = F.sum(F.length("line")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("begin", total - F.length("line") + F.col("lead"))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "").alias("history"),
        F.array_sort(F.collect_list(F.struct("turn", F.col("begin").alias("s"), (F.col("begin") + F.length("text")).alias("e")))).alias("spans"),
    )


def join_documents(docs: DataFrame, key: str) -> DataFrame:
    """A key's texts in listed order under title lines."""
    part = F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    rows = docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("part")))).alias("parts"))
    return rows.select(key, F.size("parts").alias("n_docs"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("context"))


def question_samples(lines: DataFrame) -> DataFrame:
    """Numbered phrases cut into samples where the number begins anew; each question with how many facts precede it."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("sample", F.sum((F.col("number") == 1).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.sum((~F.col("question")).cast("int")).over(Window.partitionBy("doc_id", "sample").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("facts", F.coalesce(before, F.lit(0))).where("question").select("doc_id", "sample", "line_no", "facts")
