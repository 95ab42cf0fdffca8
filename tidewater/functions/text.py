"""Scalar text functions: normalisation, answer matching, number reading, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a company's name that say nothing, and scale words with their factors.
CORPORATE = "inc co corp corporation ltd llc plc the group holdings company incorporated and of".split()
SCALES = {"billion": 1_000_000_000, "million": 1_000_000, "thousand": 1_000}
#: Fixed value: what reads as a number: optional bracket, sign, currency, grouped digits, percent.
NUMBER = r"\(?-?\$?[ \t\n\r]*[0-9][0-9,]*(?:\.[0-9]+)?[ \t\n\r]*\)?%?"
DECIMAL = "decimal(38,10)"


def squeeze(text: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def fold(text: Column) -> Column:
    return squeeze(F.lower(text))


def holds(text: Column, part: Column) -> Column:
    """Verbatim containment, white space aside."""
    return F.contains(squeeze(text), squeeze(part))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop or markup, lower-cased."""
    out = F.lower(text)
    for mark in (".", "<context>", "<example>"):
        out = F.substring_index(out, mark, 1)
    return out


def only_label(target: Column, output: Column, question: Column, labels: Column) -> Column:
    """Whether the target is the only label that the output names beyond those of the question."""
    said = F.array_distinct(F.transform(labels, F.lower))
    out, asked = first_sentence(output), F.lower(question)
    named = F.filter(said, lambda x: F.contains(out, x) & ~F.contains(asked, x))
    goal = F.lower(target)
    parts = F.split(goal, ",")
    several = F.contains(goal, F.lit(",")) & (F.length(goal) > 3)
    return F.when(several, (F.size(F.array_except(parts, named)) == 0) & (F.size(named) == F.size(parts))).otherwise(F.array_contains(named, goal) & (F.size(named) == 1))


def whole_word(text: Column, word: Column) -> Column:
    """Case-insensitive match of a whole word, by its tokens."""
    return F.array_contains(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), F.lower(word))


def read_number(token: Column) -> Column:
    """Value of a number's text; brackets or a leading minus make it negative; null if there is none."""
    digits = F.regexp_extract(F.regexp_replace(token, r"[(),$% \t\n\r]", ""), r"[0-9]+(?:\.[0-9]+)?", 0)
    value = F.nullif(digits, F.lit("")).try_cast(DECIMAL)
    minus = (F.contains(token, F.lit("(")) & F.contains(token, F.lit(")"))) | F.startswith(F.trim(token), F.lit("-"))
    return F.when(minus, -value).otherwise(value)


def scale_of(text: Column) -> Column:
    """Factor of the largest scale word in a text, else 1."""
    out = F.when(F.lit(False), F.lit(1))
    for word, factor in SCALES.items():
        out = out.when(F.lower(text).rlike(f"(^|[^a-z0-9_]){word}s?($|[^a-z0-9_])"), F.lit(factor))
    return out.otherwise(F.lit(1)).cast("long")


def number_values(text: Column) -> Column:
    """Magnitudes that a text can mean: each number as it stands, times the unit within 20 characters after it, times the text's unit."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    between = F.split(text, NUMBER, -1)
    # the 20 characters after a number: a number has one at least, so 20 numbers and what lies between them hold them all
    after = lambda k: [F.coalesce(F.get(x, k + d), F.lit("")) for d in range(1, 21) for x in (between, found)]
    following = F.transform(found, lambda _, k: F.substring(F.concat(*after(k)), 1, 20))
    whole = scale_of(text)
    each = F.zip_with(found, following, lambda t, rest: F.array(F.abs(read_number(t)), F.abs(read_number(t)) * scale_of(rest), F.abs(read_number(t)) * whole))
    return F.when(F.size(found) > 0, F.array_distinct(F.filter(F.flatten(each), lambda v: v.isNotNull()))).otherwise(F.array().cast("array<decimal(38,10)>"))


def gold_values(gold: Column) -> Column:
    value = F.abs(read_number(gold))
    return F.filter(F.array_distinct(F.array(value, value * scale_of(gold))), lambda v: v.isNotNull())


def number_match(gold: Column, answer: Column) -> Column:
    """Some magnitude of the gold value is exactly one that the answer can mean."""
    same = [F.transform(x, lambda v: v.cast(DECIMAL)) for x in (gold_values(gold), number_values(answer))]
    return F.arrays_overlap(*same)


def name_words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +"), "")


def name_match(gold: Column, answer: Column) -> Column:
    """Every telling word of a name is a word of the answer."""
    wanted = F.array_except(name_words(gold), F.array(*map(F.lit, CORPORATE)))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, name_words(answer))) == 0)


def value_match(gold: Column, answer: Column) -> Column:
    empty = (F.coalesce(gold, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == "")
    return F.when(empty, F.lit(False)).when(gold.rlike("[0-9]"), number_match(gold, answer)).otherwise(name_match(gold, answer))


def bracket_score(text: Column) -> Column:
    """A score in double, else in single brackets; null if there is none."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"\[\[([0-9]+)\]\]", r"\[([0-9]+)\]")]
    return F.coalesce(*found).cast("int")


def yes_no(text: Column) -> Column:
    """True or false for a bare yes or no, null for anything else (unresolved)."""
    said = F.lower(squeeze(text))
    return F.when(said.rlike("^yes[.!]?$"), F.lit(True)).when(said.rlike("^no[.!]?$"), F.lit(False))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text as canonical JSON."""
    quoted = F.to_json(F.array(text))
    return F.sha2(F.substring(quoted, F.lit(2), F.length(quoted) - 2).cast("binary"), 256)


def hash_shard(text: Column, shards: int) -> Column:
    """SHA-256 as a number, modulo shards: folded 16 bits at a time."""
    h = F.sha2(text.cast("binary"), 256)
    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda acc, k: F.pmod(acc * 65536 + F.conv(F.substring(h, k * 4 + 1, F.lit(4)), 16, 10).cast("long"), F.lit(shards).cast("long")))


def scored_by(metric: str, text: Column, answer: Column) -> Column:
    """em, contains, lastline_em and lastline_contains."""
    said = F.trim(text) if not metric.startswith("lastline") else F.substring_index(F.trim(text), "\n", -1)
    return said == answer if metric.endswith("em") else F.contains(said, answer)


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r]+", "$1\u0001"), "\u0001")
