"""Secret scans: candidates by form, false positives removed by a random forest, in DataFrame functions and ML only.

Candidates are the runs of words that have a long one and digits, and whole values that follow a credential's name or
stand at a password's place in a URL; a word has as many as it holds.  The forest looks at a candidate's
length, its characters and their transitions, how much of it dictionary words cover, the path it is from and the words
beside it.  It is trained from labelled findings; without a table of one's own, from findings made by rule.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.rx import let

#: Labelled findings that the forest is trained on at most, trees and their depth.
MAX_FINDINGS, TREES, DEPTH = 20_000, 40, 8
MIN_LONG, MIN_VALUE = 16, 6
THRESHOLD = 0.5

# Names of credentials, names of harmless digests and numbers, words of paths with made-up values, and
# a small dictionary of words found in identifiers and placeholders.
CREDENTIAL = "token|secret|passw(?:or)?d|passwd|pwd|api_?-?key|apikey|access_?key|private_?key|auth|bearer|credential|client_?secret|conn(?:ection)?_?string"
HARMLESS = "commit|sha|sha1|sha256|md5|checksum|digest|hash|etag|integrity|revision|uuid|guid|build|version|trace|span|request|order|invoice|isbn|phone|tel|card|account|serial|image|blob|tree|parent"
MADE_UP_PATH = "test|example|sample|fixture|mock|doc|demo|spec|tutorial"
DICTIONARY = (
    "your example sample test dummy fake change changeme replace placeholder here insert enter secret token password "
    "apikey access private public client server user admin default value string key name value none null todo module "
    "version release index table column field number page image file path home data config local host http https www "
    "com org net static assets bundle script style report order invoice account customer product service request "
    "response session cookie system library package import export build commit branch master main feature hello world "
    "the and for with this that from have not are was"
)
FEATURES = (
    "length", "digits", "capitals", "smalls", "signs", "transitions", "distinct", "entropy", "vowels", "hex",
    "dictionary", "known_form", "quoted", "assigned", "credential", "harmless", "made_up_path", "repeats",
)
_TOKEN = r"[A-Za-z0-9+/_\-]{6,}={0,2}"
# Parts of a word, first form first: a credential's name and its whole value (in quotes, or up to a quote, or to a sign
# before the next name); user and password of a URL; a run, with signs and a short name before it.  A name of six or
# more characters is a run itself.  The possessive loops do not recurse: words have any length.
_NEXT = r"[\\\"'`]*[\w.\-]+[\\\"'`]*[:=]"
_VALUE = rf"(?:\"([^\"]{{6,}})\"|'([^']{{6,}})'|`([^`]{{6,}})`|[\"'`]?((?:[^\s\"'`,;&?|\\]++|\\(?![\"'`])|[,;&?|](?!{_NEXT}))++))"
_NAMED = rf"(?i:[\w.\-]{{0,100}}?(?:{CREDENTIAL}))\\?[\"'`]?[:=]+>?\\?{_VALUE}"
_USERINFO = r"://[^\s/:@]*:([^\s/]{6,})@"
_RUN = r"(?:\b[A-Za-z_]\w{0,4})?\\?[\"'`]?[:=]*\\?[\"'`]?[A-Za-z0-9+/_\-]{6,}(?:={1,2}(?![\w\"'`+/\-]))?[\"'`]?"
_PART = f"{_NAMED}|{_USERINFO}|{_RUN}"
_END = r"[.,:;)\]}>]+$"
_KNOWN = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abp]-|^sk_(live|test)_|^eyJ[A-Za-z0-9_\-]{10,}|^AIza[A-Za-z0-9_\-]{30,}"


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, word_at, candidate, word, left_words, right_word and path of every candidate of every row.

    ``word`` is the candidate's part of the word at ``word_at``; the parts beside it are its neighbours.  A value
    that is taken whole gives its long runs as candidates too.
    """
    body, where = F.col(text), F.coalesce(F.col(path), F.lit("")) if path else F.lit("")
    hopeful = df.where(
        body.rlike(r"[A-Za-z0-9+/_\-]{16,}") & body.rlike("[0-9]") | body.rlike(f"(?i)({CREDENTIAL})") | body.rlike(_USERINFO)
    )
    split = hopeful.select(F.col(key).alias("doc_id"), where.alias("path"), F.split(body, r"\s+").alias("w"))

    def before(i: Column, n: int) -> Column:
        return F.coalesce(F.get(F.col("w"), i - n), F.lit(""))

    def is_value(i: Column) -> Column:
        named = F.concat_ws(" ", before(i, 2), before(i, 1))
        return (F.length(F.get(F.col("w"), i)) >= MIN_VALUE) & named.rlike(f"(?i)({CREDENTIAL})[\"']?\\s*[:=]+$")

    def hopeful_word(i: Column) -> Column:
        word = F.get(F.col("w"), i)
        long = (F.length(word) >= MIN_LONG) & word.rlike(r"[A-Za-z0-9+/_\-]{16,}") & word.rlike("[0-9]")
        inside = word.rlike(f"(?i)({CREDENTIAL})\\\\?[\"'`]?[:=]+>?\\\\?[\"'`]?\\S{{6,}}")
        return long | is_value(i) | inside | word.rlike(_USERINFO)

    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), hopeful_word)
    rows = split.select("doc_id", "path", "w", F.explode(at).alias("word_at"))
    word, i = F.get(F.col("w"), F.col("word_at")), F.col("word_at")
    parts = F.when(is_value(i), F.array(word)).otherwise(F.regexp_extract_all(word, F.lit(_PART), F.lit(0)))

    def beside(p: Column) -> Column:
        none = F.lit("")
        return F.transform(
            p, lambda x, k: F.struct(x.alias("word"), F.coalesce(F.get(p, k - 1), none).alias("last"), F.coalesce(F.get(p, k + 1), none).alias("next"))
        )

    rows = rows.select(
        "doc_id",
        "word_at",
        "path",
        F.concat_ws(" ", *[before(i, n) for n in (3, 2, 1)]).alias("left_words"),
        F.coalesce(F.get(F.col("w"), i + 1), F.lit("")).alias("right_word"),
        is_value(i).alias("whole"),
        F.explode(let(parts, beside)).alias("part"),
    )
    part = F.col("part.word")

    def first(pattern: str, groups: int) -> Column:
        return F.concat(*[F.regexp_extract(part, pattern, n) for n in range(1, groups + 1)])

    quoted = F.regexp_extract(part, "^([\"'`])(.{6,})\\1[.,:;)\\]}>]*$", 2)
    bare = F.regexp_replace(F.regexp_replace(part, "^[\"'`]", ""), r"[\"'`]?[.,:;)\]}>]*$", "")
    named = F.concat(first(f"^{_NAMED}", 3), F.regexp_replace(F.regexp_extract(part, f"^{_NAMED}", 4), _END, ""))
    value = (
        F.when(F.col("whole"), F.when(quoted != "", quoted).otherwise(bare))
        .when(part.rlike(f"^{_NAMED}"), named)
        .otherwise(F.regexp_extract(part, f"^{_USERINFO}", 1))
    )

    def all_of(v: Column) -> Column:
        runs = F.regexp_extract_all(v, F.lit(_TOKEN), F.lit(0))
        long = F.filter(runs, lambda x: (F.length(x) >= MIN_LONG) & x.rlike("[0-9]") & (x != v))
        run = F.regexp_extract(part, rf"([A-Za-z0-9+/_\-]{{6,}}={{0,2}})[\"'`]?$", 1)
        return F.when(F.length(v) >= MIN_VALUE, F.concat(F.array(v), long)).when(v != "", F.array()).otherwise(F.array(run))

    found = rows.select(
        "doc_id",
        "word_at",
        F.explode(let(value, all_of)).alias("candidate"),
        part.alias("word"),
        F.concat_ws(" ", "left_words", F.when(F.col("part.last") != "", F.col("part.last"))).alias("left_words"),
        F.when(F.col("part.next") != "", F.col("part.next")).otherwise(F.col("right_word")).alias("right_word"),
        "path",
    )
    return found.where(F.length("candidate") >= MIN_VALUE)


def with_features(found: DataFrame) -> DataFrame:
    """The columns of FEATURES as doubles, for rows with candidate, word, left_words, right_word and path."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    lower = F.lower(c)
    beside = F.lower(F.concat_ws(" ", "left_words", F.regexp_extract("word", r"^[^:=]*[:=]", 0), "right_word"))
    # Every run of one kind of character becomes one sign: runs - 1 transitions.
    runs = c
    for kind, sign in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), (r"[^a-zA-Z0-9]+", "-")):
        runs = F.regexp_replace(runs, kind, sign)
    letters = F.array_distinct(F.split(c, ""))

    def part(total: Column, x: Column) -> Column:
        p = (n - F.length(F.replace(c, x, F.lit("")))) / n
        return total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    words = "|".join(sorted(set(DICTIONARY.split()), key=lambda x: (-len(x), x)))
    flags = {
        "hex": lower.rlike("^[0-9a-f]+$"),
        "known_form": c.rlike(_KNOWN),
        "quoted": F.col("word").rlike("[\"'`]"),
        "assigned": F.concat_ws(" ", "left_words", "word").rlike(r"[:=]+\s*[\"'`]?[^\s:=]+$"),
        "credential": beside.rlike(rf"({CREDENTIAL})") | F.col("word").rlike(f"^{_USERINFO}"),
        "harmless": beside.rlike(rf"(^|[^a-z0-9])({HARMLESS})([^a-z0-9]|$)"),
        "made_up_path": F.lower(F.col("path")).rlike(MADE_UP_PATH),
    }
    made = {
        "length": n,
        "digits": F.regexp_count(c, F.lit("[0-9]")) / n,
        "capitals": F.regexp_count(c, F.lit("[A-Z]")) / n,
        "smalls": F.regexp_count(c, F.lit("[a-z]")) / n,
        "signs": F.regexp_count(c, F.lit("[^A-Za-z0-9]")) / n,
        "transitions": (F.length(runs) - 1) / n,
        "distinct": F.size(letters) / n,
        "entropy": F.aggregate(letters, F.lit(0.0), part),
        "vowels": F.regexp_count(lower, F.lit("[aeiou]")) / n,
        "dictionary": (n - F.length(F.regexp_replace(lower, f"({words})", ""))) / n,
        "repeats": F.regexp_count(c, F.lit(r"(.)\1\1")) / n,
    } | {k: v.cast("double") for k, v in flags.items()}
    return found.withColumns({k: F.coalesce(made[k], F.lit(0.0)) for k in FEATURES})


def made_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings by rule: credentials in several forms, and look-alikes; the same rows on every call."""
    i = F.col("id")
    hex64, other = F.sha2(i.cast("string"), 256), F.sha2(F.concat(F.lit("b"), i.cast("string")), 256)
    base62 = F.regexp_replace(F.base64(F.unhex(F.concat(hex64, other))), "[+/=]", "")
    digit = F.pmod(F.xxhash64("id"), F.lit(10)).cast("string")
    names = ["token", "secret", "api_key", "password", "auth_token", "client_secret", "access_key", "TOKEN"]
    harmless = ["commit", "checksum", "sha256", "digest", "revision", "build", "trace", "integrity"]
    words = ["module", "release", "the", "order", "account", "report", "page", "index", "website", "customer", "notebook"]

    def pick(of: list[str], salt: int) -> Column:
        return F.get(F.array(*[F.lit(x) for x in of]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))).cast("int"))

    name, plain = pick(names, 1), pick(harmless, 2)
    prose = F.concat_ws(" ", pick(words, 3), pick(words, 4))
    wordy = F.concat_ws("_", pick(words, 5), pick(words, 6), pick(words, 7), digit)
    assigned = F.concat(prose, F.lit(" "), name, F.lit(" ="))
    quote = F.lit('"')
    real = [
        (F.substring(hex64, 1, 40), assigned, True),
        (F.upper(F.substring(hex64, 1, 40)), assigned, True),
        (hex64, assigned, True),
        (F.substring(base62, 1, 40), assigned, True),
        (F.substring(base62, 3, 24), F.concat(name, F.lit(":")), True),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(base62, "[a-z]", ""), 1, 8)), F.upper(F.substring(hex64, 1, 8))), prose, False),
        (F.concat(F.lit("ghp_"), F.substring(base62, 1, 36)), prose, False),
        (F.concat(F.substring(base62, 1, 9), digit), F.concat(F.lit("password ="), F.lit("")), True),
    ]
    like = [
        (F.substring(hex64, 1, 40), F.concat(prose, F.lit(" "), plain), False),
        (hex64, F.concat(plain, F.lit(":")), False),
        (F.regexp_replace(F.substring(hex64, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.concat(prose, F.lit(" uuid")), False),
        (F.substring(F.regexp_replace(F.concat(hex64, other), "[a-f]", ""), 1, 16), prose, False),
        (F.concat(wordy, F.lit("_"), wordy), prose, False),
        (F.concat(F.lit("your_"), name, F.lit("_here_"), digit), assigned, True),
        (F.concat(F.repeat(F.lit("x"), 20), digit), assigned, True),
        (F.concat(F.lit("example-secret-value-"), digit), assigned, True),
        (F.concat(pick(words, 8), F.lit("/"), pick(words, 9), F.lit("/20240"), digit, F.lit("/"), wordy), prose, False),
        (F.substring(base62, 1, 40), assigned, True),
    ]
    forms = [*real, *like]
    parts = F.array(
        *[
            F.struct(
                c.alias("candidate"),
                (F.concat(quote, c, quote) if quoted else c).alias("word"),
                left.alias("left_words"),
                F.lit("").alias("right_word"),
                F.lit("tests/fixtures/example" if k == len(forms) - 1 else "src").alias("path"),
                F.lit(1.0 if k < len(real) else 0.0).alias("label"),
            )
            for k, (c, left, quoted) in enumerate(forms)
        ]
    )
    return spark.range(0, rows, 1, 1).select(F.get(parts, F.pmod("id", F.lit(len(forms))).cast("int")).alias("f"), "id").select("id", "f.*")


def train(findings: DataFrame, max_findings: int = MAX_FINDINGS) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, word, left_words, right_word, path, label 0 or 1).

    Of more than ``max_findings`` rows those with the lowest hashes are taken.
    """
    bounded = findings.orderBy(F.xxhash64("candidate", "left_words", "path")).limit(max_findings)
    rows = with_features(bounded.coalesce(1)).select(*FEATURES, F.col("label").cast("double").alias("label"))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=11, featuresCol="features", labelCol="label", featureSubsetStrategy="onethird"
    )
    return forest.fit(table)


def judge(found: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD) -> DataFrame:
    """``found`` with length, score (the forest's share for a secret) and is_secret."""
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(found))
    scored = model.transform(table).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    kept = [c for c in found.columns if c != "length"]
    return scored.select(
        *kept, F.col("length").cast("int").alias("length"), "score", (F.col("score") >= threshold).alias("is_secret")
    )


def scan_secrets(
    df: DataFrame,
    findings: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every candidate of every row with the forest's verdict: doc_id, word_at (of words split at white space),
    candidate, word, left_words, right_word, path, length, score and is_secret.

    A row has as many results as candidates, and so has a word; null and empty texts, and texts without candidates, have none.  Null
    paths count as empty.  Repeated rows give repeated results.  Other columns are not read.
    """
    model = train(findings if findings is not None else made_findings(df.sparkSession))
    return judge(candidates(df, key, text, path), model, threshold)
