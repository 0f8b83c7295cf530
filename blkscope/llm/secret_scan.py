"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame operations and Spark's own forest only; no Python runs on executors.
"""

from __future__ import annotations

import random
import string

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, text_of, unused, written

# Words that speak for and against a secret beside them, that make up placeholders, and parts of
# paths where examples and where settings live.
FOR = "password|passwd|passphrase|pwd|secret|token|apikey|api_key|api-key|access_key|private_key|credential|credentials|auth|bearer|key"
AGAINST = "commit|revision|sha|sha1|sha256|md5|checksum|digest|uuid|guid|id|version|release|phone|tel|card|invoice|isbn|ip|host|address|mail|email|date|image|png|build"
PLACEHOLDER = "example|sample|changeme|placeholder|dummy|your|here|insert|foobar|xxxx|none|null|true|false|environ|getenv|redacted"
EXAMPLE_PATHS = "test|tests|example|examples|doc|docs|fixture|fixtures|sample|samples|mock|mocks"
LIVE_PATHS = "config|conf|env|prod|production|deploy|settings|secrets|credentials|ops"

#: Starts of well-known kinds of keys.
PREFIX = "AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk_(?:live|test)_|AIza|eyJ|glpat-|npm_|hf_"

#: A run of so many of these characters is a candidate wherever it stands if it holds a digit, a capital
#: after a small letter or the start of a known key. Without these, a run that nothing names is a word.
SHORTEST = 12
RUN = rf"([A-Za-z0-9+/_.-]{{{SHORTEST},}})"
LIKELY = rf"[0-9]|[a-z][A-Z]|{PREFIX}"

#: Whatever a name for secrets is set to is a candidate from so many characters on, of any kind and
#: with any marks; below them lie numbers and the short words of prose.
SHORTEST_ASSIGNED = 6
SET = r"(?::=|=>|[=:])"
NAMED = rf"(?i)(?:^|[^a-z0-9])(?:{FOR})[\"'`]?"
CORE = r"^[\"'`(\[{<]*(.*?)[\"'`)\]}>,;.]*$"

FEATURES = ["length", "transitions", "digits", "capitals", "variety", "coverage", "placeholder", "separators", "marks", "hex", "prefix", "assigned", "path_example", "path_live", "neighbour_for", "neighbour_against"]
TREES, DEPTH, SEED, CUT = 24, 7, 7, 0.5

#: Letters of a dictionary word, and the share of all documents that have it (two of them at least).
#: With w different words in an average document there are at most w / WORD_SHARE words, whatever the number of documents.
WORD_SHORTEST, WORD_LONGEST, WORD_SHARE = 4, 10, 1e-4


def _share(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.length(value)


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word): words of small letters that a share of the documents has. Each document counts a word once; tasks add up their own first."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text_of(text), F.lit(rf"\b([a-z]{{{WORD_SHORTEST},{WORD_LONGEST}}})\b"), F.lit(1)))).alias("word"))
    least = max(2.0, WORD_SHARE * docs.count())
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("word")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, text_sha, more..., at, value, kind, features without coverage); at counts words from 0, those in more keep their names.

    kind is url (the password of a user in an address), assignment (what a name
    for secrets is set to), aws_key or run. A value of two kinds has the first.
    """
    rows = docs.select(F.col(key).alias("key"), *more, F.col(path).cast("string").alias("path"), text_of(text).alias("text"))
    sets = F.col("text").rlike(rf"{NAMED}\s{{0,9}}{SET}|(?i)bearer\s")
    rows = rows.withColumn("text_sha", F.sha2("text", 256)).withColumn("sets", sets)
    rows = rows.filter(F.col("sets") | F.col("text").rlike(LIKELY) | F.col("text").contains("://")).withColumn("words", F.split("text", WHITE))

    def hit(w: Column, i: Column) -> Column:
        before, two = F.get("words", i - 1), F.get("words", i - 2)
        named = before.rlike(rf"{NAMED}{SET}[\"'`]?$") | before.rlike(r"(?i)^[\"'`]?bearer$") | (before.rlike(rf"^{SET}$") & two.rlike(rf"{NAMED}$"))
        inline = F.regexp_extract(w, rf"{NAMED}{SET}[\"'`]?(.+)$", 1)
        given = F.when(F.col("sets"), F.when(inline != "", F.regexp_extract(inline, CORE, 1)).when(F.coalesce(named, F.lit(False)), F.regexp_extract(w, CORE, 1)))
        given = F.when(F.length(given) >= SHORTEST_ASSIGNED, given)
        address = F.when(w.contains("://"), F.regexp_extract(w, r"://[^/:@?#]*:([^/@?#]+)@", 1))
        address = F.when(address != "", address)
        runs = F.when((F.length(w) >= SHORTEST) & w.rlike(LIKELY), F.filter(F.regexp_extract_all(w, F.lit(RUN), F.lit(1)), lambda v: v.rlike(LIKELY)))
        return F.when(given.isNotNull() | address.isNotNull() | runs.isNotNull(), F.struct(i.alias("at"), w.alias("word"), given.alias("given"), address.alias("address"), runs.alias("runs")))

    found = rows.withColumn("hit", F.explode(F.filter(F.transform("words", hit), lambda x: x.isNotNull())))
    at, word = F.col("hit.at"), F.col("hit.word")
    near = F.lower(F.concat_ws(" ", F.get("words", at - 2), F.get("words", at - 1), F.regexp_extract(word, r"^[^A-Za-z]*([A-Za-z_-]+)[=:]", 1), F.get("words", at + 1)))
    outer = F.concat_ws(" ", "hit.given", "hit.address")
    runs = F.filter(F.array_distinct(F.coalesce("hit.runs", F.array().cast("array<string>"))), lambda v: ~F.contains(outer, v))

    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    named = F.concat(of("url", F.array_compact(F.array("hit.address"))), of("assignment", F.filter(F.array("hit.given"), lambda v: v.isNotNull() & ~F.coalesce(v.contains(F.col("hit.address")), F.lit(False)))), of("run", runs))
    found = found.select("key", "text_sha", *more, "path", at.alias("at"), near.alias("near"), F.explode(named).alias("c"))
    value, path_ = F.col("c.value"), F.coalesce("path", F.lit(""))

    def part_of(column: Column, words: str) -> Column:
        return column.rlike(rf"(?i)(?:^|[^a-z])(?:{words})(?:$|[^a-z])").cast("double")

    return found.select(
        "key", "text_sha", *more, "at", value.alias("value"),
        F.when((F.col("c.kind") != "url") & value.rlike("^A[KS]IA[0-9A-Z]{16}$"), "aws_key").otherwise(F.col("c.kind")).alias("kind"),
        F.length(value).cast("double").alias("length"),
        (F.regexp_count(value, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / F.length(value)).alias("transitions"),
        _share(value, "[0-9]").alias("digits"),
        _share(value, "[A-Z]").alias("capitals"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.length(value)).alias("variety"),
        _share(value, f"(?i)(?:{PLACEHOLDER})").alias("placeholder"),
        _share(value, "[+/_.-]").alias("separators"),
        _share(value, "[^A-Za-z0-9+/_.-]").alias("marks"),
        _share(value, "[0-9a-f]").alias("hex"),
        value.rlike(f"^(?:{PREFIX})").cast("double").alias("prefix"),
        F.col("c.kind").isin("assignment", "url").cast("double").alias("assigned"),
        part_of(path_, EXAMPLE_PATHS).alias("path_example"),
        part_of(path_, LIVE_PATHS).alias("path_live"),
        part_of(F.col("near"), FOR).alias("neighbour_for"),
        part_of(F.col("near"), AGAINST).alias("neighbour_against"),
    )


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with coverage: the share of a value's characters that dictionary words inside its letter runs cover. Each different value is looked up once.

    A letter begins at most one word of each length, so a value of any length
    costs rows in proportion to it; these name it by its digest.
    """
    digest = F.unhex(F.sha2("value", 256))
    lengths = F.sequence(F.lit(WORD_SHORTEST), F.length("run"))
    values = found.select("value").distinct().withColumn("low", F.lower("value")).filter(F.col("low").rlike(rf"[a-z]{{{WORD_SHORTEST}}}"))
    # what follows each place, as far as a word can reach
    runs = values.select(digest.alias("known"), F.posexplode(F.regexp_extract_all("low", F.lit(rf"(?=([a-z]{{0,{WORD_LONGEST}}}))"), F.lit(1))).alias("at", "run")).filter(F.length("run") >= WORD_SHORTEST)
    parts = runs.select("known", "at", F.explode(F.transform(lengths, lambda n: F.substring(F.col("run"), F.lit(1), n))).alias("word"))
    hits = parts.join(words, "word").select("known", F.explode(F.sequence(F.col("at"), F.col("at") + F.length("word") - 1)).alias("place")).distinct()
    shares = hits.groupBy("known").agg(F.count("*").alias("n"))
    told = found.join(shares, digest == F.col("known"), "left")
    return told.withColumn("coverage", F.coalesce(F.col("n") / F.length("value"), F.lit(0.0))).drop("known", "n")


#: Words for made-up findings beside those of the corpus.
COMMON = "over that when under about these along with other place later some value number server client report account window market".split()

NAMES = ["password", "passwd", "secret", "token", "api_key", "db_password", "auth_token", "access_key", "client_secret", "PWD", "apiKey"]
LIVE, PLAIN, EXAMPLE = ["config/prod", "deploy/settings", "ops/env"], ["src/app", "src1", "lib/core"], ["tests/fixtures", "docs/intro", "examples/demo"]

#: Kinds of made-up findings, in turn: twice those of secrets, once those of what is taken for them.
TRUE = ["aws", "aws_letters", "hex_inline", "hex_spaced", "mixed_inline", "mixed_spaced", "bearer", "prefixed", "prefixed_letters", "human", "human_small", "leet", "phrase", "address", "base64"]
FALSE = [
    "mail", "ip", "card", "plain_number", "commit", "checksum", "uuid", "path", "changeme", "variable", "literal", "prose", "prose_inline", "call", "camel", "snake", "version", "time", "phone", "aws_example", "image",
    "aws_in_tests",
]


def _finding(kind: str, rnd: random.Random, known: list[str]) -> str:
    """A text of that kind."""
    word = lambda: rnd.choice(known)
    of = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    upper, digits, hexes = string.ascii_uppercase, string.digits, "0123456789abcdef"
    mixed = string.ascii_letters + digits
    name, quote, space, mark = rnd.choice(NAMES), rnd.choice(['"', "'", ""]), rnd.choice(["", " "]), rnd.choice("!#$&*@-?")
    plain = {
        "aws": lambda: f"AKIA{of(upper + '234567', 16)}",
        "aws_letters": lambda: f"key AKIA{of(upper, 16)}",
        "hex_inline": lambda: f"{name}={of(hexes, rnd.randrange(12, 42))}",
        "hex_spaced": lambda: f"{name} {rnd.choice(['=', ':', ':='])} {quote}{of(hexes, rnd.randrange(24, 48))}{quote}",
        "mixed_inline": lambda: f"{name}:{quote}{of(mixed, rnd.randrange(16, 28))}{quote}",
        "mixed_spaced": lambda: f"{name}: {of(mixed, 32)}",
        "bearer": lambda: f"Authorization: Bearer {of(mixed, 36)}",
        "prefixed": lambda: f"{rnd.choice(['ghp_', 'sk_live_', 'xoxb-', 'glpat-'])}{of(mixed, 30)}",
        "prefixed_letters": lambda: f"{rnd.choice(['ghp_', 'sk_live_', 'sk_test_'])}{of(upper, 22)}",
        "human": lambda: f"{name}={space}{word().capitalize()}{of(digits, 2)}{mark}",
        "human_small": lambda: f"{name}={space}{word()}{of(digits, rnd.randrange(1, 4))}{rnd.choice(mixed)}{mark}",
        "leet": lambda: f"{name}:{space}" + (word() + word()).capitalize().translate(str.maketrans("aeios", "43105")) + mark,
        "phrase": lambda: f"{name}={word()}{word()}{word()}{word()}",
        "address": lambda: f"{rnd.choice(['postgres', 'amqp', 'https'])}://{word()}:{of(mixed, 12)}@{word()}.internal:5432/db",
        "base64": lambda: f"{name} = {quote}{of(mixed + '+/', 40)}=={quote}",
        "mail": lambda: f"{word()}.{of(digits, 3)}@{word()}{of(digits, 1)}.org",
        "ip": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)) + rnd.choice(["", ":8080"]),
        "card": lambda: f"{rnd.choice(['card', 'paid', 'no'])} {of(digits, 16)}",
        "plain_number": lambda: of(digits, rnd.randrange(12, 17)),
        "commit": lambda: f"commit {of(hexes, 40)}",
        "checksum": lambda: f"checksum sha256:{of(hexes, 64)}",
        "uuid": lambda: f"id {of(hexes, 8)}-{of(hexes, 4)}-{of(hexes, 4)}-{of(hexes, 4)}-{of(hexes, 12)}",
        "path": lambda: f"lib/python3.{of(digits, 2)}/{word()}/{word()}.html",
        "changeme": lambda: f"{name}={space}{rnd.choice(['changeme', 'placeholder', 'example', 'your_password_here', 'xxxxxxxx', '<redacted>', 'insert-token-here'])}{of(digits, 1)}",
        "variable": lambda: f"{name}={space}{rnd.choice(['os.environ[', '${', 'getenv('])}{word().upper()}_{word().upper()}" + "}",
        "literal": lambda: f"{name}{rnd.choice(['=', ': ', ' = '])}{rnd.choice(['None,', 'null', 'False;', 'string', 'required', 'optional'])}",
        "prose": lambda: f"{rnd.choice(['password', 'key', 'token', 'secret'])}: {word()} {word()}",
        "prose_inline": lambda: f"{rnd.choice(['key', 'token', 'auth'])}={word()} {word()}",
        "call": lambda: f"{rnd.choice(['token', 'key', 'secret'])} = {word()}.{word()}()",
        "camel": lambda: f"{word()}{word().capitalize()}{word().capitalize()}",
        "snake": lambda: f"{word()}_{word()}_{of(digits, 2)}",
        "version": lambda: f"release-2.{of(digits, 1)}.{of(digits, 2)}-build",
        "time": lambda: f"2024-0{rnd.randrange(1, 10)}-1{of(digits, 1)}T10:00",
        "phone": lambda: f"{rnd.choice(['phone', 'tel', 'call'])} +1-555-{of(digits, 3)}-{of(digits, 4)}",
        "aws_example": lambda: f"AKIA{of(upper + '234567', 9)}EXAMPLE",
        "image": lambda: f"image data:png;base64,{of(mixed + '+/', 44)}",
        "aws_in_tests": lambda: f"AKIA{of(upper + '234567', 16)}",
    }
    return f"{word()} {plain[kind]()} {word()}"


def labelled_findings(spark: SparkSession, words: list[str] | None = None, rows: int = 6000) -> DataFrame:
    """(doc_id, text, source, label, template): made-up findings with the look of real ones and of what is taken for them.

    rows bounds the training set; words are some of the corpus's own, for
    values made of words. Secrets are more often under settings than under
    tests, and the other way round for what is none.
    """
    known, kinds, out = [*COMMON, *(words or [])], [*TRUE, *TRUE, *FALSE], []
    for k in range(rows):
        rnd, kind = random.Random(k), kinds[k % len(kinds)]
        true = kind in TRUE
        share = rnd.random()
        path = EXAMPLE if kind == "aws_in_tests" else (LIVE if share < (0.45 if true else 0.1) else PLAIN if share < (0.95 if true else 0.65) else EXAMPLE)
        out.append((k, _finding(kind, rnd, known), rnd.choice(path), float(true), kind))
    return spark.createDataFrame(out, "doc_id long, text string, source string, label double, template string")


def some_words(words: DataFrame, most: int = 48) -> list[str]:
    """Dictionary words by the order of their hash, at most so many: for made-up findings."""
    return [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(most).collect()]


def train(findings: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", label: str = "label") -> Model:
    """The forest from labelled findings: texts with candidates, and whether they are secrets."""
    findings = written(findings.select(key, text, path, label), "findings")
    rows = covered(candidates(findings, key, text, path, (label,)), words)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", label)
    return RandomForestClassifier(labelCol=label, numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(written(ready, "features"))


def trained(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The forest for docs and their dictionary."""
    words = written(dictionary(docs, text), "dictionary")
    return train(labelled_findings(docs.sparkSession, some_words(words)), words), words


def scan(docs: DataFrame, model: Model, words: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", cut: float = CUT) -> DataFrame:
    """One row per candidate: key, text_sha, at (its word's place from 0), kind, value, probability, is_secret.

    Null and empty texts have none; a null path is one without words. Rows that
    repeat key and text give their candidates once each. A value that stands
    twice in a text is two rows. No rows: no rows. Other columns are ignored.
    """
    found = covered(written(candidates(docs, key, text, path).distinct(), "candidates"), words)
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return judged.select(F.col("key").alias(key), "text_sha", "at", "kind", "value", "probability", (F.col("probability") >= cut).alias("is_secret"))


def redacted(docs: DataFrame, model: Model, words: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of a text replaced by mark wherever it stands, all rows and columns kept. Longer secrets are replaced first. Null texts stay null."""
    k, s, values, sha = unused(docs, "k", "s", "values", "sha")
    secrets = scan(docs, model, words, key, text, path).filter("is_secret").groupBy(F.col(key).alias(k), F.col("text_sha").alias(s)).agg(F.collect_set("value").alias(values))
    secrets = written(secrets, "secrets")
    ordered = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(ordered, F.col(text).cast("string"), lambda t, v: F.replace(t, v, F.lit(mark)))
    marked = docs.withColumn(sha, F.sha2(text_of(text), 256)).join(secrets, F.col(key).eqNullSafe(F.col(k)) & (F.col(sha) == F.col(s)), "left")
    return marked.withColumn(text, F.when(F.col(values).isNotNull(), clean).otherwise(F.col(text))).select(*[f"`{c}`" for c in docs.columns])
