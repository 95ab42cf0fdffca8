"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame operations only.

A candidate is a run of token characters with a digit, a key of a known form, what is assigned to a password-like name, or a password that stands behind its user in an address or a command. The forest sees its
length, its character transitions, how much of it is dictionary words, the path that the text comes from and the words
beside it. It is trained by Spark's own forest on labelled findings, and its trees are then walked by column
expressions over arrays of nodes, so that scanning is a single pass without a shuffle.

Labelled findings are a parameter (``before, candidate, after, path, label``); by default they are made by
``labelled_findings``, a stated rule over generated keys, hashes, identifiers, placeholders and words.

Defined cases: null texts have no candidates; a null path counts as empty; a text gives a row for each candidate that stays,
repeats included; rows are independent; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of 16 or more token characters with a digit among them; '=' belongs to it only as padding at its end, and the '//' of an address does not.
CANDIDATE = r"(?:(?<![A-Za-z0-9+/_-])(?!(?<=:)//)|(?<=://))(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: What is assigned to a password-like name, both of any length, found with the name: all between quotes, else up to white space, a
#: quote, a tag or the next NAME= of a list, without punctuation at its end.
ASSIGNED = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]++[\"'`]?[ \t]*+[=:])"  # a cheap look before the long one
    r"(?=[A-Za-z0-9+/_-]*?(?i:passw|pwd|passphrase|passcode|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key))"
    r"[A-Za-z0-9+/_-]++[\"'`]?[ \t]*+[=:]{1,3}+>?[ \t]*+[\"'`]?"
    r"(?![=:>])(?:(?<=\")(?:[^\"\\\r\n]|\\.)++(?=\")|(?<=')(?:[^'\\\r\n]|\\.)++(?=')|(?<=`)(?:[^`\\\r\n]|\\.)++(?=`)"
    r"|(?:(?![&,;|][A-Za-z0-9_.-]+=)[.,;:)\]}]*+[^\s\"'`<>.,;:)\]}])++)"
)
#: ``user:password`` before the host of an address, or of a command's user option.
USER_INFO = r"(?<=:)//[^\s:/@\"'`<>]*+:(?![=:>])[^\s/@\"'`<>]++(?=@)|(?<=\s-u[ =][\"']?|--user[ =][\"']?)[^\s:=/@\"'`<>]++:(?![=:>/])[^\s\"'`<>]++"
#: Forms of keys that give themselves away, with a digit or without.
FORMS = (
    r"(?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|glpat-[A-Za-z0-9_-]{16,}+|xox[abeprs]-[A-Za-z0-9-]{10,}+"
    r"|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{30,}+|npm_[A-Za-z0-9]{30,}+|hf_[A-Za-z0-9]{30,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
)
KNOWN = rf"(?<![A-Za-z0-9])(?:{FORMS})(?![A-Za-z0-9])"
FOUND = f"{KNOWN}|{USER_INFO}|{ASSIGNED}|{CANDIDATE}"
#: The name or user that is found with a value, which only it can be followed by.
LEAD = r"^[^\s\"'`=:]*+[\"'`]?[ \t]*+[=:]{1,3}+>?[ \t]*+[\"'`]?(?=[\s\S])"
#: Characters of context on either side.
CONTEXT = 24

#: Words whose neighbourhood speaks for or against a secret, and words of the dictionary.
FOR = "token secret passw pwd passphrase api key credential auth bearer private access salt hmac pepper signing hook".split()
AGAINST = "commit sha md5 checksum digest hash uuid guid etag revision build integrity fingerprint order invoice isbn phone session-id trace".split()
PLACEHOLDER = "example dummy fake placeholder changeme sample your xxxx test redacted todo lorem foobar 1234567890 abcdefgh".split()
DICTIONARY = sorted(
    "access account address admin agent alpha animal answer apple beta book build button cache chapter city client cloud code color common config content copy country data date default demo design dev "
    "document domain east email error event example fake field file filter first folder form function gamma garden general global green group header hello home house image index input item july june key "
    "label language large last layer left level library license light line link list local login main map march master member menu message method mobile model module month name network north note number "
    "object office open option order output page paper part password path people phone photo picture place plan player point policy price primary private process product profile project public query "
    "question random record release report request response river road root sample school score search second secret section server service session setting simple site size small south space standard "
    "start state station status story stream street string style summer system table target team test text theme thumb time title token total travel type update upload user value version video view water "
    "week west white window winter word work world year".split(),
    key=lambda w: (-len(w), w),
)

#: A call, an index, a path of names, or what stands for a value to be filled in.
CODE = r"^(?:[A-Za-z_$][A-Za-z0-9_$]*+(?:(?:\.|->|::)[A-Za-z_$][A-Za-z0-9_$]*+)*+(?:[(\[]|$)|[$%]?[{(<]|\$[A-Za-z_])"

NAMES = ["length", "digits", "uppers", "distinct", "transitions", "alternation", "hex_only", "words", "path_test", "said_for", "said_against", "said_placeholder", "assigned", "quoted", "known", "user_info", "code", "mixed"]
TREES, DEPTH, FINDINGS = 24, 7, 6000


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def describe(rows: DataFrame) -> DataFrame:
    """Adds the forest's features to ``before, candidate, after, path``."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    low = F.lower(c)
    beside = F.lower(F.concat_ws(" ", "before", "after"))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    mixed = lambda x: F.when(x.rlike("[0-9]") & x.rlike("[A-Za-z]"), F.length(x)).otherwise(0)
    says = lambda text, words: text.rlike(f"(?<![a-z])({'|'.join(words)})(?![a-z])").cast("double")
    values = {
        "length": F.length(c),
        "digits": count_of(c, "[0-9]") / n,
        "uppers": count_of(c, "[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "transitions": changes / n,
        "alternation": count_of(low, "[bcdfghjklmnpqrstvwxyz][aeiou]") / n,
        "hex_only": c.rlike("^[0-9a-fA-F-]+$"),
        "words": F.coalesce(count_of(low, "|".join(DICTIONARY)), F.lit(0)) / n,
        "path_test": F.lower("path").rlike("test|example|sample|fixture|docs?/|readme|mock"),
        "said_for": F.lower("before").rlike("|".join(FOR)),
        "said_against": says(beside, AGAINST),
        "said_placeholder": says(beside, PLACEHOLDER) + low.rlike("|".join(PLACEHOLDER)).cast("double"),
        "assigned": F.col("before").rlike("[=:]\\s*[\"'`]?$"),
        "quoted": F.col("before").rlike("[\"'`]$"),
        "known": c.rlike(f"^(?:{FORMS})$"),
        "user_info": F.col("before").rlike(":$") & (F.col("after").startswith("@") | F.col("before").rlike("(?:-u|--user)[ =]")),
        "code": c.rlike(CODE) & ~F.col("before").rlike("[\"'`]$"),
        "mixed": F.array_max(F.transform(F.split(c, "[^A-Za-z0-9]"), mixed)),
    }
    return rows.withColumns({k: v.cast("double") for k, v in values.items()})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``n`` findings by rule: half secrets (random keys and passwords that are assigned, stand in addresses or options, or have a known form), half false positives.

    They are what ``candidates`` finds in the generated texts, so the forest learns from rows as a scan yields them.
    """
    r = lambda salt: F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    pick = lambda words, salt: F.array(*map(F.lit, words))[F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))).cast("int")]
    base64 = F.translate(F.base64(F.unhex(r("b"))), "=", "")
    size = (F.lit(16) + F.pmod(F.xxhash64("id", F.lit("size")), F.lit(25))).cast("int")
    uuid = F.concat_ws("-", r("u").substr(1, 8), r("u").substr(9, 4), r("u").substr(13, 4), r("u").substr(17, 4), r("u").substr(21, 12))
    slug = F.concat_ws("-", *[pick(DICTIONARY, f"w{k}") for k in range(4)], F.pmod("id", F.lit(90)).cast("string"))
    worded = F.concat(*[pick(DICTIONARY, f"v{k}") for k in range(4)])
    # a generator lets a row's parts be computed once, and not wherever they are used
    parts = {"base64": base64, "size": size, "uuid": uuid, "slug": slug, "worded": worded}
    rows = lambda first: spark.range(first, n, 2, 4).select("id", F.explode(F.array(F.struct(*(v.alias(k) for k, v in parts.items())))).alias("part"))
    base64, size, uuid, slug, worded = (F.col(f"part.{k}") for k in parts)
    secret = F.array(r("h").substr(F.lit(1), size), r("h").substr(1, 40), F.substring(base64, 1, 40), F.concat(F.lit("AKIA"), F.upper(r("a").substr(1, 16))), F.concat(pick(["ghp_", "sk-", "xoxb-", "glpat-"], "p"), F.substring(base64, 1, 32)))
    # passwords: short ones with punctuation, ones without a digit, and very long ones
    short = F.concat(F.substring(base64, 1, 4), pick(["&", "!", "#", "$", "%", "@"], "t"), F.substring(base64, 9, 5))
    secret = F.concat(secret, F.array(short, worded, F.substring(F.repeat(base64, 20), 1, 800)))
    named = F.concat(pick(["", "aws_", "my ", "the ", "prod-", "user "], "q"), pick(["token", "secret", "password", "api_key", "auth_token", "private_key", "access_key", "credential"], "n"), pick([" = \"", ": ", "=", "='", ": \"", " = "], "e"))
    false = F.array(r("c").substr(1, 40), r("m").substr(1, 32), uuid, slug, F.concat(pick(["your_", "EXAMPLE", "test_", "xxxx", "sample-"], "y"), r("x").substr(1, 4), F.lit("1234567890abcdefgh")), F.translate(r("d"), "abcdef", "012345").substr(F.lit(1), size), F.concat(F.lit("AKIAIOSFODNN7"), F.lit("EXAMPLE")))
    # and what is assigned to such a name in prose, code and forms
    word = pick(["required", "none", "null", "true", "changeme", "get_token(request)", "os.environ", "string", "${PASSWORD}", "the", "your_password"], "g")
    false = F.concat(false, F.array(pick(DICTIONARY, "o"), word, word, F.substring(F.repeat(base64, 20), 1, 800)))
    plain = F.array(F.lit("commit "), F.lit("md5: "), F.lit("uuid "), F.lit("see /images/"), F.concat(pick(["token = \"", "api_key: "], "k"), F.lit("")), F.lit("order no. "), F.lit("aws_access_key = \""), *[pick(["password: ", "token = ", "the secret: ", "password=\"", "api_key="], f"l{k}") for k in range(3)], F.lit("data:image/png;base64,"))
    # each kind is what stands before, the value and what stands after
    after = pick(["\"", "", " and more", "'", "\"\nnext line", " the"], "z")
    kind_of = lambda *parts: F.struct(*(x.alias(k) for k, x in zip(("lead", "value", "tail"), (F.lit(p) if isinstance(p, str) else p for p in parts), strict=True)))
    user, host = pick(["root", "svc", "mailer", "build-7", "kim.lee"], "user"), F.concat(pick(DICTIONARY, "h"), pick([".net", ".org:6379/0", "-1.internal", ":21"], "hh"))
    address, option = pick(["ftp://", "redis://", "amqp://", "smtp://", "jdbc://"], "a"), pick(["wget --user ", "http GET -u ", "fetch -u '", "sync --user="], "o2")
    password = F.array(short, F.substring(base64, 5, 24), F.concat(worded, F.lit("7")), F.substring(base64, 3, 11))[F.pmod(F.xxhash64("id", F.lit("pw")), F.lit(4)).cast("int")]
    letters = F.lower(F.translate(base64, "0123456789+/", "aeioulnrstmd")).substr(F.lit(1), size)
    quoted = F.concat(pick(["", "db_", "my_", "user-"], "q3"), pick(["password", "secret", "passphrase", "credential"], "n3"), pick([" = \"", ": \"", "=\"", "\": \""], "e3"))
    said_secret = [kind_of(quoted, v, "\"") for v in (worded, letters)] + [kind_of(named, v, after) for v in (secret[k] for k in range(8))] + [
        kind_of(F.concat(address, user, F.lit(":")), password, F.concat(F.lit("@"), host)),
        kind_of(F.concat(option, user, F.lit(":")), password, pick([" ", "' "], "o3")),
        kind_of(pick(["use ", "(\"", "https://", "# ", "header: "], "f"), F.concat(pick(["glpat-", "npm_", "hf_"], "f2"), F.translate(F.substring(F.repeat(base64, 2), 1, 40), "+/", "xy")), pick([" now", "\")", "@git.site/x.git", ""], "f3")),
        kind_of(F.concat(pick(["https://webhooks.", "curl https://hook.", "POST //hooks."], "g2"), pick(DICTIONARY, "g3"), F.lit(".")), F.concat(pick(["net/in/", "com/send/", "io/v2/"], "g5"), F.upper(r("i").substr(F.lit(1), (size / 3).cast("int"))), pick(["/", "/Q7/", "/B2KX09/"], "g6"), F.translate(base64, "+/", "xy").substr(F.lit(1), size)), pick(["\"", "", " "], "g4")),
        kind_of(F.concat(pick(["https://webhooks.", "curl https://hook.", "POST //hooks."], "g7"), pick(DICTIONARY, "g8"), F.lit(".")), F.concat(pick(["net/in/", "com/send/", "io/v2/"], "g5"), F.upper(r("i").substr(F.lit(1), (size / 3).cast("int"))), pick(["/", "/Q7/", "/B2KX09/"], "g6"), F.translate(base64, "+/", "xy").substr(F.lit(1), size)), pick(["\"", "", " "], "g4")),
        kind_of(pick(["COOKIE_HMAC=", "export HASH_PEPPER=", "signing-seed: "], "j"), F.array(r("h").substr(1, 32), r("h"))[F.pmod(F.xxhash64("id", F.lit("j1")), F.lit(2)).cast("int")], "\nNEXT=1"),
    ]
    name = lambda salt: pick(DICTIONARY, salt)
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(40)).cast("string")
    call = F.concat(name("c1"), pick([".", "->", ".get_", "_"], "c2"), name("c3"), pick([".", "_", "::"], "c4"), name("c5"), pick(["(", "[", "(request, ", "(self."], "c6"), number, pick([")", "]", ");"], "c7"))
    member = F.concat(name("c1"), F.lit("."), name("c3"), pick([".", "_"], "c4"), name("c5"), pick(["", "2", "_id"], "c8"))
    filled = pick(["${TOKEN}", "$PASS", "{password}", "<password>", "{{ secret }}", "%(pw)s", "user", "pass", "password"], "c9")
    unquoted = F.concat(pick(["", "my_", "next_", "user_"], "q2"), pick(["token", "secret", "password", "api_key", "credential"], "n2"), pick([" = ", "=", ": ", " := "], "e2"))
    said_false = [kind_of(plain[k], false[k], after) for k in range(11)] + [
        kind_of(unquoted, call, pick(["", "\n", " # next"], "z2")),
        kind_of(unquoted, call, pick(["", "\n", " # next"], "z2")),
        kind_of(unquoted, member, pick(["", "\n", ", other"], "z3")),
        kind_of(F.concat(address, pick(["user", "name", "me"], "u2"), F.lit(":")), filled, F.concat(F.lit("@"), host)),
        kind_of(F.concat(option, F.lit("1000:")), pick(["1000", "100", "0"], "u3"), " run"),
        kind_of(pick(["BUILD_SHA=", "export COMMIT=", "etag: ", "REVISION=", "trace="], "j2"), F.array(r("c").substr(1, 40), r("m").substr(1, 32))[F.pmod(F.xxhash64("id", F.lit("j3")), F.lit(2)).cast("int")], "\nNEXT=1"),
        kind_of(F.concat(F.lit("https://cdn."), name("w1"), F.lit(".")), F.concat(F.lit("net/"), name("w2"), F.lit("/"), r("c").substr(1, 32)), ".js"),
        kind_of(F.concat(F.lit("https://www."), name("w1"), F.lit(".")), F.concat(F.lit("org/20"), number, F.lit("/"), slug), pick(["", "/", ".html"], "w4")),
    ]
    chosen = lambda kinds, salt: F.array(*kinds)[F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(kinds))).cast("int")]
    yes = F.col("id") % 2 == 0
    of = lambda first, kinds, salt: rows(first).select("id", F.explode(F.array(chosen(kinds, salt))).alias("said"))
    texts = of(0, said_secret, "of").unionByName(of(1, said_false, "kind"))
    texts = texts.select(
        F.col("id").alias("doc_id"),
        F.concat("said.lead", "said.value", "said.tail").alias("text"),
        F.when(yes, pick(["src/app.py", "config/prod.env", "deploy.sh", "src1", "notes.txt", "tests/test_api.py"], "s")).otherwise(pick(["docs/readme.md", "tests/fixture.json", "src/app.py", "src2", "CHANGELOG", "notes.txt"], "s")).alias("path"),
    )
    return candidates(texts, path_col="path").select("before", "candidate", "after", "path", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.0).alias("label"))


def tree_arrays(root) -> dict[str, list]:
    """A tree of Spark's as arrays by node: feature, threshold, where to go, and the share of secrets there. Leaves go to themselves."""
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "low", "high", "share")}

    def add(node) -> int:
        at, stats = len(out["share"]), list(node.impurityStats().stats())
        leaf = node.getClass().getSimpleName() == "LeafNode"
        for k, v in (("feature", 0), ("threshold", 0.0), ("low", at), ("high", at), ("share", float(stats[1] / sum(stats)))):
            out[k].append(v)
        if not leaf:
            split = node.split()
            out["feature"][at], out["threshold"][at] = split.featureIndex(), float(split.threshold())
            out["low"][at], out["high"][at] = add(node.leftChild()), add(node.rightChild())
        return at

    add(root)
    return out


def tree_score(tree: dict[str, list], depth: int, x: Column) -> Column:
    """The share of secrets at the leaf that feature array ``x`` reaches: one step down for each level."""
    fixed = {k: F.lit(v) for k, v in tree.items()}
    step = lambda node, _: F.when(F.get(x, F.get(fixed["feature"], node)) <= F.get(fixed["threshold"], node), F.get(fixed["low"], node)).otherwise(F.get(fixed["high"], node))
    return F.get(fixed["share"], F.aggregate(F.lit(list(range(depth))), F.lit(0), step))


def fit_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[dict[str, list]]:
    """Of labelled findings, each tree as arrays."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(describe(findings)).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(rows)
    return [tree_arrays(t._call_java("rootNode")) for t in forest.trees]


#: The forest of the default findings: they follow from a rule, so it is fitted once a driver and kept as arrays.
FITTED: list[list[dict[str, list]]] = []


def default_forest(spark: SparkSession) -> list[dict[str, list]]:
    if not FITTED:
        FITTED.append(fit_forest(labelled_findings(spark)))
    return FITTED[0]


def forest_score(described: DataFrame, forest: list[dict[str, list]], depth: int = DEPTH) -> DataFrame:
    """Adds ``score``. The features pass a generator first, so that Spark computes them once and not in every tree."""
    rows = described.withColumn("x", F.explode(F.array(F.array(*NAMES))))
    return rows.withColumn("score", F.round(sum((tree_score(t, depth, F.col("x")) for t in forest), F.lit(0.0)) / len(forest), 6)).drop("x")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id, ordinal, candidate, before, after, path``; ordinal counts the candidates of a text, from 0."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), path.alias("path")).where(F.col("t").rlike(FOUND))
    rows = rows.select("doc_id", "path", F.regexp_extract_all("t", F.lit(FOUND), F.lit(0)).alias("found"), F.split("t", FOUND, -1).alias("between"))
    rows = rows.select("doc_id", "path", "found", "between", F.posexplode("found").alias("k", "match"))
    rows = rows.withColumn("lead", F.regexp_extract("match", LEAD, 0))
    before = F.concat(F.coalesce(F.get("found", F.col("k") - 1), F.lit("")), F.col("between")[F.col("k")], "lead")
    return rows.select(
        "doc_id",
        F.col("k").alias("ordinal"),
        F.expr("substring(match, length(lead) + 1)").alias("candidate"),
        F.right(before, F.lit(CONTEXT)).alias("before"),
        F.left(F.col("between")[F.col("k") + 1], F.lit(CONTEXT)).alias("after"),
        "path",
    )


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id, ordinal, candidate, score`` of the candidates that the forest lets stand."""
    forest = default_forest(docs.sparkSession) if findings is None else fit_forest(findings)
    described = describe(candidates(docs, id_col, text_col, path_col))
    return forest_score(described, forest).where(F.col("score") >= threshold).select("doc_id", "ordinal", "candidate", "score")
