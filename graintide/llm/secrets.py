"""Secret scan with a random forest that removes false positives.

Candidates are runs of 12 or more key characters that hold a digit or a change
from lower to upper case, and whatever of 6 or more characters is assigned to a name with a
sensitive word (``password = ...``, ``"secret": ...``); three parts joined by points that begin as a
signed token does are one.  A forest, trained from labelled findings, judges each
by its length, character transitions (by a table of classes that is learnt from the findings too),
dictionary coverage, the path it stands under and its neighbouring words.  The trees become one column expression over
the candidate's features, so a scan is a single pass over the texts in built-in
functions: no join, no shuffle and no Python on the executors.

Findings to train from are a table (text, path, value, label): any team's triaged
results fit.  ``labelled_findings`` derives a bounded default set from given texts: known kinds of
keys and look-alikes (digests, identifiers, placeholders, numbers) set between
words of the scanned texts.

Defined cases: null and empty texts have no findings; a value that stands
several times in a text is a finding each time; equal texts get equal findings; an empty
table gives an empty result; a null path counts as empty.  Columns other than key, text and path are not read.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.llm.common import keep, table

_RUN = "[A-Za-z0-9+/_-]"
VALUE = f"eyJ{_RUN}+\\.{_RUN}+\\.{_RUN}+|{_RUN}{{12,}}={{0,2}}"
HINT = f"(?<!{_RUN})(?={_RUN}{{12}})[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z])"
#: Words whose letters make a value look written rather than drawn.
DICTIONARY = """access account address admin agent alert alpha amount auth backup base batch beta branch build bucket cache
change check class client cloud code color command commit common config connect content control count create customer
data date default delta demo deploy detail device digest docs domain download email engine entry error event example
export feature field file filter final folder format from general group guide handler hash header home host image import
index info input item java json label layer level library license line link list local login main manager master media
member message meta method model module month name network node note number object office option order output owner
package page panel parameter part party path payment phone picture plan point policy port post price print private
process product profile project public python query queue read record region release remote report request reset result
review role root rule sample schema script search section select server service session setting share sheet source
spec state status store stream string style summary support system table target task team template temp test text
theme time title token total track type union unit update upload user value vendor version video view web week widget
window word work world write year your zone""".split()
SENSITIVE = "(?i)(token|secret|passw|pwd|api[_-]?key|apikey|auth|credential|private|access[_-]?key|bearer)"
_CELL = "[^\\s\"'`()\\[\\]{}<>,;]"
_ASSIGNED = f"({_CELL}{{5,}}[^\\s\"'`()\\[\\]{{}}<>,;.:!?])"
#: A value in the same word as its sensitive name, at the start of a later word, and the cheap signs of either.
INNER = f"{SENSITIVE}[A-Za-z0-9_-]*[\"']?[=:]+[\"'`(]*{_ASSIGNED}"
OUTER = f"^[\"'`(\\[{{<]*{_ASSIGNED}"
ANY_ASSIGNED = f"{SENSITIVE}[A-Za-z0-9_-]*[\"']?\\s*[=:]"
DECOY = "(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|hash|uuid|guid|isbn|order|invoice|tracking|version|build|etag|revision|phone|card|account|image|file|url|http)"
PLACEHOLDER = "(?i)(x{4,}|example|sample|dummy|your|changeme|placeholder|0{6,}|12345|abcdef)"
SIDE_PATH = "(?i)(test|example|sample|fixture|mock|demo|docs?/|spec|lock)"
FEATURES = ("length", "transitions", "vowels", "digits", "upper", "covered", "hex", "distinct", "side_path", "sensitive", "decoy", "assigned", "placeholder", "numeric", "likelihood")
KINDS = 19
MAX_FINDINGS, TREES, DEPTH = 300 * KINDS, 20, 6
_CLASSES = ("aeioubcdfghjklmnpqrstvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "v" * 5 + "c" * 21 + "d" * 10 + "u" * 26)


def _pairs(value: Column) -> Column:
    """Array of the classes (vowel, consonant, digit, upper, other) of every two neighbouring characters."""
    classes = F.regexp_replace(F.translate(value, *_CLASSES), "[^vcdu]", "o")
    return F.regexp_extract_all(classes, F.lit("(?=(..))"), 1)


def _likelihood(value: Column, transitions: dict[str, float]) -> Column:
    """Mean log ratio of a value's transitions, secrets against others; 0 without a table."""
    if not transitions:
        return F.lit(0.0)
    table_ = F.create_map(*[F.lit(x) for pair in sorted(transitions.items()) for x in pair])
    total = F.aggregate(_pairs(value), F.lit(0.0), lambda t, p: t + F.coalesce(F.try_element_at(table_, p), F.lit(0.0)))
    return total / F.greatest(F.char_length(value) - 1, F.lit(1))


def _features(c: Column, transitions: dict[str, float]) -> list[Column]:
    value, near = c["value"], F.concat_ws(" ", c["before2"], c["before"], c["word"])
    n = F.char_length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return [
        n,
        share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        share("(?i)[aeiou](?=[b-df-hj-np-tv-z])"),
        share("[0-9]"),
        share("[A-Z]"),
        1 - F.char_length(F.regexp_replace(value, f"(?i){'|'.join(DICTIONARY)}", "")) / n,
        flag(value.rlike("^[0-9a-fA-F]+$")),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40.0)),
        flag(c["path"].rlike(SIDE_PATH)),
        flag(near.rlike(SENSITIVE)),
        flag(F.concat_ws(" ", near, c["after"]).rlike(DECOY)),
        flag(c["before"].rlike("[=:]$") | c["word"].rlike("[\"'=:]")),
        flag(value.rlike(PLACEHOLDER)),
        flag(value.rlike("^[0-9-]+$")),
        _likelihood(value, transitions),
    ]


def candidates(text: Column, path: Column, transitions: dict[str, float] | None = None) -> Column:
    """Array of a text's candidates with their place (the word's number), neighbours and features."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    word = lambda ws, i: F.coalesce(F.when(i >= 0, F.get(ws, i)), F.lit(""))
    none = F.lit("")
    # each word beside the two before it, in one pass; the last rows of the zip have no word
    beside = F.arrays_zip(words.alias("word"), F.concat(F.array(none), words).alias("before"), F.concat(F.array(none, none), words).alias("before2"))
    numbered = F.transform(beside, lambda z, i: F.struct(i.alias("at"), z["word"].alias("word"), z["before"].alias("before"), z["before2"].alias("before2")))
    inside = lambda s: s["word"].rlike("[=:]") & s["word"].rlike(INNER)
    before = lambda s: s["before"].rlike("[=:][\"']?$") & (s["before"].rlike(SENSITIVE) | (s["before"].rlike("^[=:]+$") & s["before2"].rlike(SENSITIVE)))
    spots = F.filter(numbered, lambda s: s["word"].isNotNull() & (s["word"].rlike(HINT) | inside(s) | before(s)))

    def values(s: Column) -> Column:
        assigned = F.concat(F.regexp_extract_all(s["word"], F.lit(INNER), 2), F.when(before(s), F.regexp_extract_all(s["word"], F.lit(OUTER), 1)).otherwise(F.array().cast("array<string>")))
        assigned = F.array_distinct(assigned)
        runs = F.filter(F.regexp_extract_all(s["word"], F.lit(f"({VALUE})"), 1), lambda v: v.rlike(HINT))
        return F.concat(assigned, F.filter(runs, lambda v: ~F.exists(assigned, lambda a: F.contains(a, v))))

    found = F.flatten(
        F.transform(
            spots,
            lambda s: F.transform(
                values(s),
                lambda v, k: F.struct(s["at"].alias("word_index"), k.alias("nth"), v.alias("value"), s["word"].alias("word"), s["before"].alias("before"), s["before2"].alias("before2"), word(words, s["at"] + 1).alias("after"), path.alias("path")),
            ),
        )
    )
    rated = F.transform(found, lambda c: F.struct(c["word_index"].alias("word_index"), c["nth"].alias("nth"), c["value"].alias("value"), *[f.alias(n) for f, n in zip(_features(c, transitions or {}), FEATURES, strict=True)]))
    return F.when(text.rlike(HINT) | text.rlike(ANY_ASSIGNED), rated)


def labelled_findings(docs: DataFrame, text: str = "text", most: int = MAX_FINDINGS) -> DataFrame:
    """A bounded default training table: (text, path, value, label, kind), from ``most`` distinct texts in order of their hash.

    Each text lends its first words as surroundings, and a counter stands in where there are too few texts; the values' kinds are in equal shares.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    near = docs.select(F.xxhash64(own).alias("h"), F.slice(F.split(own, r"\s+"), 1, 8).alias("w")).dropDuplicates(["h"]).withColumn("made", F.lit(0))
    spare = docs.sparkSession.range(most).select(F.xxhash64(F.lit("spare"), "id").alias("h"), F.array().cast("array<string>").alias("w"), F.lit(1).alias("made"))
    near = near.unionByName(spare).orderBy("made", "h").limit(most).drop("made")
    near = near.withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(KINDS - 1))))
    h = lambda salt: F.sha1(F.concat_ws("/", F.lit(salt), F.col("h").cast("string"), F.col("kind").cast("string")).cast("binary"))
    b64 = lambda salt: F.base64(F.unhex(h(salt)))
    flat = lambda c: F.regexp_replace(c, "[+/=]", "")
    pick = lambda *words: F.get(F.array(*map(F.lit, words)), F.pmod(F.col("h"), F.lit(len(words))).cast("int"))
    kinds = [
        (h("a"), 1, F.concat(pick("token", "auth_token", "TOKEN", "secret"), F.lit(' = "{}"'))),
        (F.substring(h("b"), 1, 32), 1, F.concat(pick("api_key", "API-KEY", "apikey"), F.lit(": {}"))),
        (flat(F.concat(b64("c"), b64("d"))), 1, F.concat(pick("secret", "client_secret", "private key"), F.lit(' = "{}"'))),
        (F.concat(pick("AKIA", "ASIA"), F.upper(F.substring(flat(b64("e")), 1, 16))), 1, F.concat(pick("access_key", "credentials", "auth"), F.lit(" {}"))),
        (F.concat(pick("ghp_", "sk-", "xoxb-"), F.substring(flat(F.concat(b64("f"), b64("g"))), 1, 36)), 1, F.concat(pick("Bearer", "token:", "the secret"), F.lit(" {}"))),
        (F.substring(F.concat(b64("i"), h("j")), 1, 20), 1, F.concat(pick("password", "passwd", "pwd"), F.lit("='{}'"))),
        (h("k"), 1, F.concat(pick("credential", "access-key", "secret token"), F.lit(" = {}"))),
        (h("l"), 0, F.concat(pick("commit", "revision", "sha1"), F.lit(" {}"))),
        (F.substring(F.concat(h("m"), h("n")), 1, 64), 0, F.concat(pick("sha256:", "checksum =", "digest"), F.lit(" {}"))),
        (F.regexp_replace(F.substring(h("o"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), 0, F.concat(pick("uuid", "request id", "guid ="), F.lit(" {}"))),
        (F.rpad(F.regexp_replace(h("p"), "[a-f]", ""), 16, "7"), 0, F.concat(pick("card", "is", "la", "account", "und"), F.lit(" {}"))),
        (F.concat(pick("your", "EXAMPLE", "dummy", "changeme"), F.lit("_token_"), F.substring(h("q"), 1, 4)), 0, F.concat(pick("token", "secret", "password"), F.lit(' = "{}"'))),
        (F.concat(pick("getUserName", "updateSessionState", "buildRequestHeader"), F.substring(h("r"), 1, 1), F.lit("Handler")), 0, F.concat(pick("call", "method", "token from"), F.lit(" {}"))),
        (F.concat(pick("build", "release", "image"), F.lit("-2024-"), F.substring(h("s"), 1, 2), pick("-final", "-test", "-sample")), 0, F.concat(pick("version", "file", "see"), F.lit(" {}"))),
        (F.concat(F.substring(flat(b64("t")), 1, 3), pick("!", "#", "$", "%", "@"), F.substring(flat(b64("u")), 1, 4)), 1, F.concat(pick("password", "passwd", "db_password"), F.lit(' = "{}"'))),
        (F.substring(F.translate(h("v"), "0123456789abcdef", "qzjxkvwplmtrhgfd"), 1, 16), 1, F.concat(pick("secret", "client_secret", "auth_token"), F.lit(": {}"))),
        (F.concat(F.lit("eyJ"), F.substring(flat(b64("w")), 1, 20), F.lit("."), flat(b64("x")), F.lit("."), flat(b64("y"))), 1, F.concat(pick("Bearer", "token:", "auth ="), F.lit(" {}"))),
        (F.coalesce(F.get(F.filter(F.col("w"), lambda x: x.rlike("^[a-z\u00df-\u00ff]{6,}$")), 0), pick("required", "optional", "undefined", "disabled", "unknown", "expired", "provided")), 0, F.concat(pick("password", "secret", "token", "credentials"), pick(": {}", ' = "{}"', "= {}"))),
        (F.concat(pick("request.", "config.", "os.environ.", "self."), pick("headers", "password", "session_token", "value", "secret_name")), 0, F.concat(pick("token", "secret", "password", "auth"), F.lit(" = {}"))),
    ]
    cell = functools.reduce(lambda c, k: c.when(F.col("kind") == k[0], F.struct(k[1][0].alias("value"), F.lit(k[1][1]).alias("label"), k[1][2].alias("form"))), enumerate(kinds), F)
    path = pick("src/main.py", "conf/prod.env", "lib/util.go", "app/server.rb", "tests/test_a.py", "docs/guide.md", "web/index.js", "notes.txt")
    return near.withColumn("c", cell).select(
        F.concat_ws(" ", F.slice("w", 1, 4), F.replace(F.col("c.form"), F.lit("{}"), F.col("c.value")), F.slice("w", 5, 4)).alias("text"), path.alias("path"), F.col("c.value").alias("value"), F.col("c.label").alias("label"), "kind"
    )


def _tree(lines: list[str], at: int, field) -> tuple[Column, int]:
    """Column of the node printed at lines[at], and the line after it."""
    line = lines[at].strip()
    if m := re.fullmatch(r"Predict: ([\d.]+)", line):
        return F.lit(float(m[1])), at + 1
    m = re.fullmatch(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
    low, at = _tree(lines, at + 1, field)
    high, at = _tree(lines, at + 1, field)
    return F.when(field(int(m[1])) <= float(m[2]), low).otherwise(high), at


class Forest:
    """A trained forest as a column: the share of trees that call a candidate a secret."""

    def __init__(self, printed: str, transitions: dict[str, float], model=None) -> None:
        self.transitions, self.model = transitions, model
        lines = [x for x in printed.splitlines()[1:] if x.strip()]
        starts = [i for i, x in enumerate(lines) if x.strip().startswith("Tree ")]
        self.trees = [lines[a + 1 : b] for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]

    def score(self, candidate: Column) -> Column:
        votes = [_tree(t, 0, lambda k: candidate[FEATURES[k]])[0] for t in self.trees]
        return functools.reduce(Column.__add__, votes) / len(votes)


def _transitions(findings: DataFrame) -> dict[str, float]:
    """Log ratio of each transition between classes, given the first: secrets against others, every count one more."""
    counted = findings.select("label", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("label", "pair").count()
    n = {(int(r["label"]), r["pair"]): r["count"] for r in counted.collect()}  # at most 50 rows
    out = {}
    for a in "vcduo":
        total = {label: sum(n.get((label, a + b), 0) + 1 for b in "vcduo") for label in (0, 1)}
        for b in "vcduo":
            out[a + b] = math.log((n.get((1, a + b), 0) + 1) / total[1]) - math.log((n.get((0, a + b), 0) + 1) / total[0])
    return out


def train(findings: DataFrame, seed: int = 2) -> Forest:
    """Forest from labelled findings (text, path, value, label); bound the table before."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    transitions = _transitions(findings)
    rows = findings.select("value", "label", F.explode(candidates(F.col("text"), F.col("path"), transitions)).alias("c")).filter(F.col("c.value") == F.col("value"))
    rows = rows.select(F.col("label").cast("double").alias("label"), *[F.col(f"c.{n}").alias(n) for n in FEATURES])
    rows = keep(rows, "findings").repartition(1).sortWithinPartitions(*FEATURES, "label")  # bounded, and read by every pass of the fit
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features"))
    return Forest(model.toDebugString, transitions, model)


def scan(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row a candidate: its place, digest, length, score and whether it is a secret (score of 0.5 or more)."""
    rows = docs.select(F.col(key).alias("doc_id"), candidates(F.col(text), F.coalesce(F.col(path).cast("string"), F.lit("")), forest.transitions).alias("found"))
    rows = rows.select("doc_id", F.explode(F.transform("found", lambda c: F.struct(c["word_index"].alias("word_index"), c["nth"].alias("nth"), c["value"].alias("value"), forest.score(c).alias("score")))).alias("c"))
    return rows.select("doc_id", "c.word_index", "c.nth", F.char_length("c.value").alias("value_chars"), F.sha2(F.col("c.value").cast("binary"), 256).alias("value_sha256"), F.round("c.score", 4).alias("score"), (F.col("c.score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest, text: str = "text", path: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every confirmed value replaced by the mark wherever it stands by itself; other texts stay as they are.

    Where it is part of a longer run of letters and digits it stays, since a short value may be part of any word.
    """
    good = F.filter(candidates(F.col(text), F.coalesce(F.col(path).cast("string"), F.lit("")), forest.transitions), lambda c: forest.score(c) >= 0.5)
    values = F.array_distinct(F.transform(good, lambda c: c["value"]))
    longest = F.array_sort(values, lambda a, b: F.char_length(b) - F.char_length(a))
    quoted = lambda v: F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
    put = mark.replace("\\", "\\\\").replace("$", "\\$")
    clean = F.aggregate(longest, F.col(text), lambda t, v: F.regexp_replace(t, quoted(v), F.lit(put)))
    return docs.withColumn(text, F.coalesce(clean, F.col(text)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(labelled_findings(docs, most=MAX_FINDINGS // KINDS)))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are blanked out of the texts; every document stays.

    Null and empty texts stay as they are; equal texts change alike; an empty table
    gives an empty result; other columns are returned as they were.
    """
    return redact(docs, train(labelled_findings(docs, most=MAX_FINDINGS // KINDS)))
