"""Secret scans: wide candidate patterns, and a random forest that removes false findings.

Candidates are values of six characters or more that a credential word is given, and runs of at least twelve token
characters with a digit. The forest sees a value's length, character transitions, dictionary coverage and path marks,
and the words before and after it. Labels for its training come from issuers' formats, the name that a value is directly
given to, a value's plain shape, or an identifying word before it. Where a name or a word gave the label, that stretch is
blanked in what the forest is trained on, so it can't learn the rule by reading it; a format or a plain shape is part of
the value, of which the forest sees lengths and shares only. Its trees become one column expression, so scoring needs neither joins nor
Python. DataFrame and SQL functions throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Words that name credentials; patterns and formats (fixed values).
CREDENTIAL = "(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
NAMED = rf"""(?i)(?<![A-Za-z0-9])(?:[A-Za-z0-9]{{1,30}}+[_-]){{0,4}}?{CREDENTIAL}s?(?:[_-][A-Za-z0-9]{{1,30}}+){{0,3}}["']?[ \t]{{0,3}}[:=][ \t]{{0,3}}"""
BESIDE = rf"(?i)(?<![A-Za-z0-9]){CREDENTIAL}s?[ \t]{{1,3}}"
TOKEN = r"[A-Za-z0-9+/_~.@-]{12,}+={0,2}"
CANDIDATE = rf"""{NAMED}(?:"[^"\s]{{6,200}}"|'[^'\s]{{6,200}}'|[^\s"',;]{{6,}})|(?:{BESIDE})?{TOKEN}"""
ISSUED = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^eyJ[A-Za-z0-9_-]{10,}\.|^sk-[A-Za-z0-9]{20,}$|^AIza[A-Za-z0-9_-]{35}$"
#: Words beside values that identify or verify something.
IDENTIFYING = "(?:commit|revision|sha[0-9]*|md5|hash|digest|checksum|uuid|guid|isbn|issn|doi|version|release|etag|serial|order|invoice|tracking|build)"
CUT = "\ufdd0"  # parts text and candidates; in a text itself it counts as a space
CONTEXT = 40  # characters on either side that the forest's features may read
LEAST_VOTE = 0.5
TREES, DEPTH = 20, 7
TRAINING_ROWS = 4000  # labelled findings of each class at most
BUCKETS = 4096  # of the dictionary by hash
DICTIONARY = 2000  # commonest words of the corpus
REAL_WEIGHT = 4.0  # of a finding of the corpus; one made by KINDS weighs 1
SHOWN = rf"(?i)(?<![a-z]){IDENTIFYING}[ \t:=#]{{1,3}}$"
LEAST_SHARE = 20_000  # a dictionary word makes up one in so many words of the corpus at least
FEATURES = ["length", "digits", "capitals", "switches", "runs", "distinct", "covered", "other_marks", "slashes", "dots", "groups", "at_sign", "hex", "quoted", "assigned", "plain_before", "plain_after", "credential_near", "identifying_near"]


def cut_text(text: Column) -> Column:
    """array<string>: by turns what stands between candidates, and candidates; the first and the last are of the former."""
    return F.split(F.regexp_replace(F.translate(text, CUT, " "), CANDIDATE, f"{CUT}$0{CUT}"), CUT, -1)


def _finding(found: Column, before: Column, after: Column) -> Column:
    """struct<lead, value, named, before, after> of a candidate and the text on both sides; lead: characters before the
    value in it; before ends with the value's own name."""
    rest = F.regexp_replace(F.regexp_replace(found, f"^{NAMED}", ""), f"^{BESIDE}", "")
    value = F.regexp_extract(rest, "(?s)^[\"']?(.*?)[\"'.:!?)]*$", 1)
    lead = F.length(found) - F.length(rest) + F.when(rest.rlike("^[\"']"), 1).otherwise(0)
    return F.struct(
        lead.alias("lead"), value.alias("value"), found.rlike(f"^{NAMED}").alias("named"), F.concat(F.substring(before, -CONTEXT, CONTEXT), F.substring(found, F.lit(1), lead)).alias("before"), F.substring(after, 1, CONTEXT).alias("after")
    )


def findings(parts: Column) -> Column:
    """array<struct<lead, value, named, before, after>> of the candidates of cut_text()."""
    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: _finding(F.get(parts, i), F.get(parts, i - 1), F.get(parts, i + 1)))


def worth(c: Column) -> Column:
    """Whether a finding is a candidate: long enough, and with a digit where it has no name."""
    return (F.length(c["value"]) >= 6) & (c["named"] | (F.length(c["value"]) >= 12) & c["value"].rlike("[0-9]"))


def _bucket(word: Column) -> Column:
    return (F.crc32(word.cast("binary")) % BUCKETS).cast("int")


def _hashed(words: list[str]) -> Column:
    """Array of BUCKETS strings, each with the words of one hash between blanks: one literal, which Spark splits once."""
    held = [" "] * BUCKETS
    for w in words:
        held[zlib.crc32(w.encode()) % BUCKETS] += f"{w} "
    return F.split(F.lit("|".join(held)), "[|]")


def features(c: Column, words: list[str]) -> list[Column]:
    """The forest's inputs, in the order of FEATURES. c: value, before and after; words: the dictionary, which Spark looks
    up by hash."""
    value = c["value"]
    length = F.length(value).cast("double")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    plain = lambda text: F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 2)
    letters = lambda ws: F.aggregate(ws, F.lit(0), lambda s, w: s + F.length(w))
    table = _hashed(words)
    known = lambda ws: F.filter(ws, lambda w: F.contains(F.get(table, _bucket(w)), F.concat(F.lit(" "), w, F.lit(" "))))
    share = lambda text: F.size(known(plain(text))).cast("double") / F.greatest(F.size(plain(text)), F.lit(1))
    around = F.concat(c["before"], F.lit(" "), c["after"])
    return [
        length,
        count("[0-9]") / length,
        count("[A-Z]") / length,
        count("[0-9][A-Za-z]|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])") / length,
        count("[A-Za-z]+|[0-9]+") / length,
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / length,
        letters(known(plain(value))) / length,
        count("[^A-Za-z0-9/.@_-]") / length,
        count("/"),
        count("[.]"),
        count("[-_]"),
        count("@"),
        value.rlike("^[0-9a-f]+$").cast("double"),
        c["before"].rlike("[\"']$").cast("double"),
        c["before"].rlike("[:=][ \t]*[\"']?$").cast("double"),
        share(c["before"]),
        share(c["after"]),
        c["before"].rlike(f"(?i){CREDENTIAL}").cast("double"),
        around.rlike(f"(?i)(?<![a-z]){IDENTIFYING}(?![a-z])").cast("double"),
    ]


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The corpus's commonest words of two letters or more, counted over all texts, ties by the word. Only words of one
    in LEAST_SHARE, which can't be more than so many, are put in order. (Spark doubles the work before an inner explode, to
    leave out empty arrays; an outer one does it once.)"""
    words = docs.select(F.explode_outer(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 2)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = counts.join(F.broadcast(counts.agg(F.sum("n").alias("total"))), F.col("n") * LEAST_SHARE >= F.col("total"))
    return [r.word for r in often.orderBy(F.desc("n"), "word").limit(most).collect()]


def labelled_findings(docs: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """(value, before, after, label, weight) of findings, labelled by rule: 1 where a value has an issuer's format, or is
    directly given to a credential name and mixes letters and digits; 0 for addresses, numbers, plain words, paths, and
    what an identifying word stands before. The name or word that gave a label is taken out of `before`. About `most` of
    each class, by a hash; others stay unlabelled. A value that is found often counts once. Each finding also comes
    without the text around it, so that a value's own shape has to tell."""
    cut = docs.where(F.col("text").isNotNull()).select(F.explode_outer(_let(cut_text(F.col("text")), findings)).alias("c"))
    found = cut.where(worth(F.col("c"))).groupBy("c.value").agg(F.min(F.struct("c.named", "c.before", "c.after", "c.lead")).alias("c")).select("value", "c.*")
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    plain = F.col("value").rlike(r"@[A-Za-z0-9-]+\.|^[0-9.+-]+$|^[A-Za-z.+/_~-]+$|^[a-z]+[0-9]{1,4}$|/[A-Za-z]+/")
    shown, issued = F.col("before").rlike(SHOWN), F.col("value").rlike(ISSUED)
    label = F.when(issued, 1.0).when(F.col("named") & mixed & ~F.col("value").contains("@"), 1.0).when(plain & ~F.col("named") | shown, 0.0)
    unnamed = F.when(F.col("named"), F.expr("substring(before, 1, greatest(length(before) - lead, 0))")).otherwise(F.col("before"))
    blind = F.when(issued, F.col("before")).otherwise(F.regexp_replace(unnamed, SHOWN, " "))
    kept = stage(found.withColumn("label", label).where("label is not null").select("value", blind.alias("before"), "after", "label", F.lit(REAL_WEIGHT).alias("weight")), "labelled")
    n = {r.label: r.n for r in kept.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    one_in = [F.lit(max(1, n.get(y, 0) // most)) for y in (0.0, 1.0)]
    chosen = kept.where(F.pmod(F.xxhash64("value"), F.when(F.col("label") == 0.0, one_in[0]).otherwise(one_in[1])) == 0)
    alone = F.struct("value", F.lit("").alias("before"), F.lit("").alias("after"), "label", "weight")
    return chosen.select(F.inline(F.array(F.struct(*chosen.columns), alone)))


#: Kinds of labelled findings made by rule, beside the corpus's own: (kind, label, text before, value, text after). In
#: values h is a hash in hex, u its capitals, d its digits, m its letters of both cases and digits, i a number.
KINDS = [
    ("cloud key", 1, "", "AKIA{u16}", ""), ("hex token", 1, 'token = "', "{h40}", '"'), ("hex password", 1, "password=", "{h18}", " "), ("host token", 1, "", "ghp_{m36}", " "), ("mixed key", 1, "api_key: ", "{m24}", ""),
    ("payment key", 1, "", "sk_live_{m24}", " "), ("lab token", 1, "token ", "glpat-{m20}", ""), ("short password", 1, "DB_PASSWORD=", "{m8}", ""), ("marked password", 1, 'password: "', "{m4}!{m4}#{m3}", '"'), ("signed token", 1, "Bearer ", "eyJ{m20}.{m30}.{m27}", ""), ("bare key", 1, "use ", "{m40}", " for it"),
    ("address", 0, "write to ", "user{h3}@mail.example.com", " today"), ("number", 0, "number ", "{d16}", ""), ("path", 0, "see ", "/usr/share/doc{d1}/readme.txt", ""), ("release", 0, "version ", "release-2024.01.{i}", ""), ("word", 0, "the ", "internationalisation{i}", " of"),
    ("commit", 0, "commit ", "{h40}", ""), ("checksum", 0, "sha256: ", "{h64}", ""), ("uuid", 0, "uuid ", "{h8}-{h4}-{h4}-{h4}-{h12}", ""), ("link", 0, "http://", "www.example.com/page/{i}/index.html", " and"), ("log", 0, "in ", "run-202401{d2}-{d6}.log", ""), ("md5", 0, "md5 ", "{h32}", " of the file"), ("etag", 0, "etag: ", "{m22}", ""), ("order", 0, "order ", "{u8}-{d6}", " was sent"), ("build", 0, "build ", "{h12}", ""), ("serial", 0, "serial no. ", "{u12}{d4}", ""), ("host", 0, "on ", "node-{i}.cluster.example.org", ""), ("word after name", 0, "password ", "configuration", " is"),
]


def decoys(spark: SparkSession, kinds: list[tuple] = KINDS, each: int = 120) -> DataFrame:
    """(kind, value, before, after, label, weight): `each` findings of each kind, made from counters by hashing. One
    reading of the counters makes all kinds: each reading costs the driver a buffer of some megabytes."""
    n = spark.range(each).select(F.col("id"), *(F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 512).alias(k) for k in ("h", "x", "y")))
    mixed = F.translate(F.concat("x", F.upper("y")), "0123456789abcdefABCDEF", "3KmP8vRz4tQhw7XfLpgZJdBn")
    sources = {"h": F.col("h"), "u": F.translate(F.upper("h"), "01", "XY"), "d": F.translate("h", "abcdef", "314159"), "m": F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.concat(F.substring(mixed, k, F.lit(1)), F.substring(mixed, k + 128, F.lit(1)))))}
    n = stage(n.select("id", *(c.alias(k) for k, c in sources.items())), "counters")

    def made(pattern: str) -> Column:
        out, at = [], 1
        for k, part in enumerate(pattern.replace("}", "{").split("{")):
            if k % 2 and part == "i":
                out.append(F.col("id").cast("string"))
            elif k % 2:
                out.append(F.substring(part[0], at, int(part[1:])))
                at += int(part[1:]) if at < 60 else 0
            else:
                out.append(F.lit(part))
        return F.concat(*out)

    rows = [F.struct(F.lit(k).alias("kind"), made(v).alias("value"), F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(float(y)).alias("label"), F.lit(1.0).alias("weight")) for k, y, b, v, a in kinds]
    return n.select(F.inline(F.array(*rows)))


def _tree(node) -> tuple | float:
    """A tree as (feature, threshold, low side, high side); a leaf is its share of secrets."""
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def _leaf(tree: tuple | float, f: Column) -> Column:
    """The leaf that an array of features comes to."""
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, low, high = tree
    return F.when(f[feature] <= threshold, _leaf(low, f)).otherwise(_leaf(high, f))


class Forest:
    """Trained trees, with the dictionary that the features need."""

    def __init__(self, trees: list[tuple | float], words: list[str]):
        self.trees, self.words = trees, words

    def vote(self, c: Column) -> Column:
        """The trees' mean vote for one finding; 0 if it isn't worth one."""
        f = F.transform(F.array(F.array(*features(c, self.words))), lambda f: sum((_leaf(t, f) for t in self.trees), F.lit(0.0)) / len(self.trees))
        return F.when(worth(c), f[0]).otherwise(0.0)


def train(findings: DataFrame, words: list[str], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest from labelled findings (value, before, after, label, weight)."""
    c = F.struct("value", "before", "after")
    # Dealt first, so that the features' expressions stand once, not in each branch that the findings come from
    rows = findings.repartition(2).select("label", "weight", *(f.alias(n) for n, f in zip(FEATURES, features(c, words), strict=True)))
    rows = stage(rows, "features")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(ready)
    return Forest([_tree(t._call_java("rootNode")) for t in model.trees], words)


def trained(docs: DataFrame) -> Forest:
    return train(labelled_findings(docs).unionByName(decoys(docs.sparkSession).drop("kind")), dictionary(docs))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) in which the value is worked out once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def _scan(text: Column, forest: Forest, body: Callable[[Column, Column], Column]) -> Column:
    """body(parts, marks): the text in parts, and array<struct<lead, value, vote>> of its candidates."""
    mark = lambda c: F.struct(c["lead"].alias("lead"), c["value"].alias("value"), forest.vote(c).alias("vote"))
    return _let(cut_text(text), lambda parts: _let(F.transform(findings(parts), mark), lambda marks: body(parts, marks)))


def _spans(parts: Column, marks: Column, least: float) -> Column:
    """array<struct<start, end, value, vote>> of the findings that stay: parts are gone through once."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string,vote:double>>")
    steps = F.transform(marks, lambda m, i: F.struct(F.length(F.get(parts, 2 * i)).alias("gap"), F.length(F.get(parts, 2 * i + 1)).alias("whole"), m.alias("m")))

    def step(s: Column, c: Column) -> Column:
        start = s["at"] + c["gap"] + c["m"]["lead"]
        one = F.struct(start.alias("start"), (start + F.length(c["m"]["value"])).alias("end"), c["m"]["value"].alias("value"), c["m"]["vote"].alias("vote"))
        return F.struct((s["at"] + c["gap"] + c["whole"]).alias("at"), F.when(c["m"]["vote"] >= least, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return F.when(parts.isNotNull(), F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"]))


def _masked(text: Column, parts: Column, marks: Column, least: float, hidden: str) -> Column:
    """The text with the findings that stay replaced, joined from its parts; as it was where there are none."""

    def part(p: Column, i: Column) -> Column:
        m = F.get(marks, F.floor((i - 1) / 2).cast("int"))
        shown = F.concat(F.substring(p, F.lit(1), m["lead"]), F.lit(hidden), F.substring(p, m["lead"] + F.length(m["value"]) + 1, F.length(p)))
        return F.when((i % 2 == 1) & (m["vote"] >= least), shown).otherwise(p)

    return F.when(F.exists(marks, lambda x: x["vote"] >= least), F.array_join(F.transform(parts, part), "")).otherwise(text)


def found(docs: DataFrame, forest: Forest, least: float = LEAST_VOTE, name: str = "secrets") -> DataFrame:
    """All columns of the rows, and in `name` (in place of a column of that name) array<struct<start, end, value, vote>>
    of the findings that stay, in order; code points from 0, end exclusive.

    Null texts have a null array, texts without findings an empty one; repeated rows stay, an empty table gives none.
    Equal votes need no order, as findings don't overlap. A text is cut once and gone through once.
    """
    return docs.withColumn(name, _scan(F.col("text"), forest, lambda parts, marks: _spans(parts, marks, least)))


def masked(docs: DataFrame, forest: Forest, least: float = LEAST_VOTE, hidden: str = "[SECRET]") -> DataFrame:
    """The rows with the findings that stay replaced in `text`; other columns are left as they are. Null texts stay null;
    repeated rows stay; an empty table gives none. In a text with a finding that stays, U+FDD0 comes out as a space."""
    text = F.col("text")
    return docs.withColumn("text", _scan(text, forest, lambda parts, marks: _masked(text, parts, marks, least, hidden)))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    both = lambda parts, marks: F.struct(_spans(parts, marks, LEAST_VOTE).alias("secrets"), _masked(text, parts, marks, LEAST_VOTE, "[SECRET]").alias("masked"))
    rows = docs.select("doc_id", _scan(text, trained(docs), both).alias("s")).select("doc_id", "s.secrets", "s.masked")
    span = F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return rows.select(
        "doc_id",
        F.coalesce(F.size("secrets"), F.lit(0)).cast("bigint").alias("n_secrets"),
        F.concat_ws(",", span).alias("spans"),
        F.sha2(F.coalesce("masked", F.lit("")).cast("binary"), 256).alias("redacted_sha256"),
    )
