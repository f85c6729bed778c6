"""Secret scans: candidate strings from words, judged by a random forest, in DataFrame and ML pipeline operations only.

Candidates are runs of 16 or more of [A-Za-z0-9+/_-] within a word, and whatever its length the value that a word on secrets
is assigned (password=, token: or secret = in the words before) and the password of a URL.  Features: length, changes of
character class, how likely the transitions between characters are, shares of classes, distinct characters, how much of the
string begins a piece of a public vocabulary, whether it looks like a path, and words near it.  The forest is fitted on
labelled findings, which are given or made by `labelled_findings`.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import public_tokenizers
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import cut, hinted

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}"
_BLANKS = r"[\x20\x09-\x0D]+"
_NAMES = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|credentials?)"
#: A word on secrets and the value that it is assigned within one word; one that ends with the assignment; the password of a URL.
_ASSIGNED = rf"(?i){_NAMES}[\"']?(?:[:=]|:=|=>)[\"']?([^\"'<>,;()\[\]{{}}]{{4,}})"
_ASSIGNS = rf"(?i){_NAMES}[\"']?(?:[:=]|:=|=>)[\"']?$"
_IN_URL = r"://[^/:@\s]+:([^/@\s]{4,})@"
_NAMED, _SIGN, _VALUE = rf"(?i){_NAMES}[\"']?$", r"^(?:[:=]|:=|=>)[\"']?$", r"^[\"']?([^\"'<>,;()\[\]{}]{4,})"

#: Findings that a forest is fitted on at most, in hash order.
MAX_LABELLED = 20_000

#: The vocabulary whose pieces count as dictionary words and give the likelihood of transitions.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Lengths of the letter sequences that are looked up, and bits of the table of those that begin a piece.
_PIECES, _BITS = (4, 5, 6), 1 << 18

SPEAKS = r"(?i)token|secret|passw|passwd|pwd|api[_-]?key|apikey|auth|bearer|credential|private"
DENIES = r"(?i)example|sample|dummy|placeholder|commit|sha1|sha256|md5|checksum|digest|uuid|guid|card|order|phone|invoice"

FEATURES = ("length", "transitions", "likely", "digits", "uppers", "lowers", "others", "hex_only", "distinct", "covered", "path_like", "assigned", "quoted", "speaks", "denies", "test_path", "all_digits", "cloud_prefix")


@lru_cache(maxsize=2)
def transitions(path: str = VOCABULARY) -> tuple[float, ...]:
    """Logarithms of the shares of the pairs of characters (letters in lower case; 0: others, 27: digits) in the pieces of a vocabulary, 28 x 28 in a row."""
    code = lambda c: c - 96 if 97 <= c <= 122 else 27 if 48 <= c <= 57 else 0
    pairs: Counter = Counter()
    for piece in read_ranks(path):
        own = [code(c) for c in piece.lower().strip()]
        pairs.update(zip(own, own[1:]))
    return tuple(round(math.log((pairs[a, b] + 0.5) / (sum(pairs[a, x] for x in range(28)) + 14)), 4) for a in range(28) for b in range(28))


@lru_cache(maxsize=2)
def beginnings(path: str = VOCABULARY) -> tuple[str, ...]:
    """Letter sequences of the given lengths with which a piece of the vocabulary begins."""
    found = set()
    for piece in read_ranks(path):
        word = piece.decode("latin-1").strip().lower()
        if word.isascii() and word.isalpha():
            found.update(word[:n] for n in _PIECES if len(word) >= n)
    return tuple(sorted(found))


def _slot(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(_BITS))


def piece_bits(spark: SparkSession, path: str = VOCABULARY) -> str:
    """The table of the vocabulary's beginnings as numbers of 32 bits, joined by commas: a constant of a bounded size, whatever the data."""
    words = spark.range(1).select(F.explode(F.split(F.lit(",".join(beginnings(path))), ",")).alias("w")).select(_slot(F.col("w")).alias("slot")).distinct()
    numbers = [0] * (_BITS // 32)
    for (slot,) in words.collect():  # at most as many as the vocabulary has
        numbers[slot // 32] |= 1 << slot % 32
    return ",".join(map(str, numbers))


def _share(value: Column, drop: str) -> Column:
    """Share of the characters that the pattern matches."""
    return 1 - F.length(F.regexp_replace(value, drop, "")) / F.length(value)


def features(found: DataFrame, bits: str) -> DataFrame:
    """found: value, before (up to two words), word (the whole word), word_prefix, after, path; adds FEATURES as doubles.  bits: as piece_bits gives them."""
    # computed once a candidate, not once a character: in lower case, and with all digits as "{" and all else as "`", the neighbours of a to z
    found = found.withColumn("_low", F.lower("value")).withColumn("_coded", F.translate(F.regexp_replace("_low", "[^a-z0-9]", "`"), "0123456789", "{" * 10))
    low = F.col("_low")
    code = lambda i: F.ascii(F.substring("_coded", i, F.lit(1))) - 96
    table = F.lit(",".join(map(str, transitions())))
    known = F.split(F.lit(bits), ",").cast("array<long>")
    steps = F.when(F.length(low) > 1, F.sequence(F.lit(1), F.length(low) - 1)).otherwise(F.array().cast("array<int>"))
    likely = F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.get(F.split(table, ",").cast("array<double>"), code(i) * 28 + code(i + 1)))
    begins = lambda i, n: (F.length(low) - i + 1 >= n) & (F.call_function("shiftright", F.get(known, F.floor(_slot(F.substring(low, i, n)) / 32)), (_slot(F.substring(low, i, n)) % 32).cast("int")) % 2 == 1)
    # one place for all lengths: the plan holds the table once, and the driver keeps the texts of plans
    covered = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.exists(F.array(*map(F.lit, _PIECES)), lambda n: begins(i, n))))
    value, near = F.col("value"), F.concat_ws(" ", "before", "word_prefix")
    collapsed = value
    for kind, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[+/_\\-]+", "-")):
        collapsed = F.regexp_replace(collapsed, kind, mark)
    n = F.length(value)
    columns = {
        "length": n,
        "transitions": (F.length(collapsed) - 1) / F.greatest(n - 1, F.lit(1)),
        "likely": likely / F.greatest(n - 1, F.lit(1)),
        "digits": _share(value, "[0-9]"),
        "uppers": _share(value, "[A-Z]"),
        "lowers": _share(value, "[a-z]"),
        "others": _share(value, "[^A-Za-z0-9]"),
        "hex_only": value.rlike("^[0-9a-fA-F]+$").cast("int"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "covered": covered / n,
        "path_like": F.col("word").rlike(r"[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+/|\\|://|\.[a-z]{2,4}$").cast("int"),
        "assigned": F.coalesce(F.col("word_prefix").rlike(r"[=:]['\"]?$") | F.col("before").rlike(r"[=:]\s*$"), F.lit(False)).cast("int"),
        "quoted": F.coalesce(F.col("word_prefix").rlike("['\"]$"), F.lit(False)).cast("int"),
        "speaks": F.coalesce(near.rlike(SPEAKS), F.lit(False)).cast("int"),
        "denies": F.coalesce(F.concat_ws(" ", near, "after").rlike(DENIES), F.lit(False)).cast("int"),
        "test_path": F.coalesce(F.col("path").rlike(r"(?i)test|example|fixture|mock|docs?/"), F.lit(False)).cast("int"),
        "all_digits": value.rlike("^[0-9]+$").cast("int"),
        "cloud_prefix": value.rlike("^(AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk-|AIza|eyJ)").cast("int"),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()}).drop("_low", "_coded")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """A row for each candidate of the whole texts: id, text_key, word_index (from 0), nth (among the word's different candidates, from 0), value, word, word_prefix, before, after, path.

    A value that a word holds twice is one candidate, with what stands before the first.
    """
    text, words = F.col(text_col), F.split(F.col(text_col), _BLANKS)
    path = F.col(path_col).cast("string").alias("path") if path_col in docs.columns else F.lit(None).cast("string").alias("path")
    some = docs.where(text.rlike(CANDIDATE) | text.rlike(rf"(?i){_NAMES}[\"']?[\x20\x09-\x0D]*[:=]") | text.rlike(_IN_URL)).select(F.col(id_col), F.md5(text).alias("text_key"), path, words.alias("words"))
    at = lambda i, k: F.coalesce(F.get("words", i - k), F.lit(""))
    after_sign = lambda i: at(i, 1).rlike(_ASSIGNS) | (at(i, 1).rlike(_SIGN) & at(i, 2).rlike(_NAMED))
    odd = lambda w, i: w.rlike(CANDIDATE) | w.rlike(_ASSIGNED) | w.rlike(_IN_URL) | (after_sign(i) & w.rlike(_VALUE))
    places = F.filter(F.transform("words", lambda w, i: F.when(odd(w, i), i)), lambda i: i.isNotNull())
    some = some.select(id_col, "text_key", "path", "words", F.explode(places).alias("word_index"))
    near = lambda k: at(F.col("word_index"), -k)
    some = some.select(id_col, "text_key", "path", "word_index", near(0).alias("word"), F.concat_ws(" ", near(-2), near(-1)).alias("before"), near(1).alias("after"), after_sign(F.col("word_index")).alias("assigned_before"))
    every = lambda pattern: F.regexp_extract_all("word", F.lit(pattern), F.lit(1))
    values = F.concat(every(f"({CANDIDATE})"), every(_ASSIGNED), every(_IN_URL), F.when(F.col("assigned_before"), every(_VALUE)).otherwise(F.array().cast("array<string>")))
    found = some.select("*", F.posexplode(F.array_remove(F.array_distinct(values), "")).alias("nth", "value")).drop("assigned_before")
    return found.withColumn("word_prefix", F.expr("substring_index(word, value, 1)"))


#: Beginnings and ends of words in four languages and in code, of which harmless findings are made.
WORDS = ("able", "account", "ada", "ado", "ando", "api", "ation", "ben", "ber", "cion", "com", "config", "con", "data", "der", "des", "ele", "ent", "est", "eur", "file", "for", "gen", "hand", "heit", "her", "ible", "ica", "ing", "ion", "keit", "key", "lib", "lich", "ment", "mente", "name", "ness", "nung", "ous", "path", "per", "que", "request", "rer", "sch", "secret", "ser", "service", "src", "test", "ter", "the", "tion", "token", "tor", "ung", "user", "ver", "wort")


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled findings made by rule, from hashes of the row number: kinds of secrets and of harmless strings; kind is the number of the rule."""
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{salt}")), 256)
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.conv(F.substring(h(salt), 1, 6), 16, 10).cast("long") % len(options) + 1).cast("int"))
    size = lambda salt, least, most: (F.conv(F.substring(h(salt), 7, 6), 16, 10).cast("long") % (most - least + 1) + least).cast("int")
    cased = lambda salt, m: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(salt), h(salt + "x")))), "=", "A"), F.lit(1), m)
    upper = lambda salt, m: F.substring(F.translate(F.upper(cased(salt, F.lit(64))), "+/", "X7"), F.lit(1), m)
    stem = WORDS
    phrase = lambda salt, k: F.concat(*[pick(f"{salt}{i}", stem) for i in range(k)])
    prose = ("of", "the", "and", "", "est", "que", "der", "los", "was", "with")
    word = lambda salt: pick(salt, prose)
    none, q = F.lit(""), '"'
    kinds = [
        # value, before, word_prefix, after, path, label
        (F.concat(F.lit("AKIA"), upper("a", F.lit(16))), F.concat_ws(" ", word("b1"), word("b2")), none, word("c"), "app", 1),
        (F.concat(F.lit("AKIA"), upper("a", F.lit(16))), F.concat_ws(" ", pick("b1", ("aws_access_key_id", "key", "access")), F.lit("=")), F.lit(""), word("c"), "app", 1),
        (F.substring(h("a"), 1, 40), F.concat_ws(" ", pick("b", ("token", "secret", "api_key", "auth_token")), F.lit("=")), F.lit(q), word("c"), "app", 1),
        (F.substring(h("a"), F.lit(1), size("s", 16, 32)), F.concat_ws(" ", word("b1"), word("b2")), pick("b", ("password=", "passwd=", "pwd=", "secret=", "token=", "api_key=")), word("c"), "app", 1),
        (cased("a", size("s", 24, 44)), F.concat_ws(" ", pick("b", ("secret:", "token:", "api-key:", "password:")), none), F.lit(""), word("c"), "app", 1),
        (cased("a", size("s", 20, 40)), F.concat_ws(" ", F.lit("Authorization:"), F.lit("Bearer")), none, word("c"), "app", 1),
        (F.concat(F.lit("ghp_"), F.translate(cased("a", F.lit(36)), "+/", "aB")), F.concat_ws(" ", word("b1"), word("b2")), none, word("c"), "app", 1),
        (F.concat(F.lit("sk-"), F.translate(cased("a", size("s", 32, 48)), "+/", "cD")), F.concat_ws(" ", word("b1"), word("b2")), none, word("c"), "app", 1),
        (F.concat(F.initcap(pick("p", stem)), F.substring(F.translate(F.sha2(h("z"), 256), "abcdef", "#!%@&$"), F.lit(1), size("s", 4, 8))), F.concat_ws(" ", word("b1"), word("b2")), pick("b", ("password=", "passwd:", "pwd=", "secret=")), word("c"), "app", 1),
        (F.translate(cased("a", size("s", 6, 12)), "+/=aeiou", "&!#43105"), F.concat_ws(" ", pick("b1", ("password", "secret", "pwd", "passphrase")), pick("b2", ("=", ":"))), none, word("c"), "app", 1),
        (F.concat(pick("p", stem), F.translate(F.substring(h("z"), 1, 5), "abcdef", "579XQ!")), F.concat_ws(" ", word("b1"), word("b2")), F.lit("https://user:"), word("c"), "app", 1),
        (pick("p", ("required", "optional", "string", "None", "null", "true", "changeme", "here", "your_password", "required.", "must", "the", "missing", "empty")), F.concat_ws(" ", pick("b1", ("password", "token", "secret", "pwd")), pick("b2", ("=", ":"))), none, word("c"), "app", 0),
        (phrase("p", 2), F.concat_ws(" ", word("b1"), pick("b2", ("password:", "token:", "secret:"))), none, word("c"), "app", 0),
        (pick("p", stem), F.concat_ws(" ", word("b1"), word("b2")), pick("b", ("password=", "token=", "secret:", "pwd=")), word("c"), "app", 0),
        (phrase("p", 5), F.concat_ws(" ", word("b1"), word("b2")), none, word("c"), "app", 0),
        (F.initcap(phrase("p", 6)), F.concat_ws(" ", word("b1"), word("b2")), none, word("c"), "app", 0),
        (phrase("p", 7), F.concat_ws(" ", word("b1"), word("b2")), none, word("c"), "app", 0),
        (F.upper(phrase("p", 5)), F.concat_ws(" ", word("b1"), word("b2")), none, word("c"), "app", 0),
        (F.lpad(F.conv(F.substring(h("a"), 1, 13), 16, 10), 16, "4"), F.concat_ws(" ", word("b1"), word("b2")), none, word("c"), "app", 0),
        (F.concat_ws("-", *[F.substring(h("a"), i, m) for i, m in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.concat_ws(" ", word("b1"), pick("b", ("uuid", "id", "guid", "request"))), none, word("c"), "app", 0),
        (F.substring(h("a"), 1, 40), F.concat_ws(" ", word("b1"), pick("b", ("commit", "sha1", "checksum", "digest"))), none, word("c"), "app", 0),
        (F.concat_ws("/", *[pick(f"p{i}", stem) for i in range(4)]), F.concat_ws(" ", word("b1"), word("b2")), none, word("c"), "app", 0),
        (F.concat_ws("_", *[pick(f"p{i}", stem) for i in range(4)]), F.concat_ws(" ", word("b1"), F.lit("=")), none, word("c"), "app", 0),
        (F.concat_ws("-", F.lit("your"), pick("b", ("api", "secret", "token")), F.lit("key-goes-here")), F.concat_ws(" ", pick("b", ("api_key", "secret", "token")), F.lit("=")), F.lit(q), word("c"), "docs/example", 0),
        (F.repeat(pick("b", ("x", "0", "-", "*")), 24), F.concat_ws(" ", pick("b1", ("password", "token", "key")), F.lit("=")), F.lit(q), word("c"), "docs/example", 0),
        (F.substring(h("a"), 1, 32), F.concat_ws(" ", F.lit("example"), pick("b", ("token", "key"))), F.lit(q), F.lit("example"), "tests/fixture", 0),
    ]
    rows = spark.range(0, n, 1, 1)
    out = None
    for i, (value, before, prefix, after, path, label) in enumerate(kinds):  # a branch for each kind keeps the generated code small
        own = rows.where(F.col("id") % len(kinds) == i).select(value.alias("value"), F.coalesce(before, F.lit("")).alias("before"), prefix.alias("word_prefix"), after.alias("after"), F.lit(path).alias("path"), F.lit(label).alias("label"), F.lit(i).alias("kind"))
        out = own if out is None else out.unionByName(own)
    return out.where(F.length("value") >= 4).withColumn("word", F.concat("word_prefix", "value"))


class Forest(NamedTuple):
    model: RandomForestClassificationModel
    bits: str


def fit(labelled: DataFrame, trees: int = 30, depth: int = 8, seed: int = 7) -> Forest:
    """The forest of labelled findings (value, before, word, word_prefix, after, path, label); of more than MAX_LABELLED those with the smallest hashes."""
    some = labelled.orderBy(F.xxhash64("value", "before", "word_prefix"), "value", "before").limit(MAX_LABELLED)
    bits = piece_bits(labelled.sparkSession)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(some, bits)).select("features", F.col("label").cast("double").alias("label")).coalesce(1)
    rows = cut(rows)  # the fit reads them several times
    return Forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows), bits)


def judged(found: DataFrame, forest: Forest) -> DataFrame:
    """found with score (the forest's share for a secret) and is_secret (0.5 or more)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(found, forest.bits))
    out = forest.model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.select(*found.columns, "score", (F.col("score") >= 0.5).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """A row for each candidate: id, word_index, nth, value_length, value_sha256, score, is_secret.

    Null and empty texts have no candidates; repeated rows give repeated findings; a null path tells nothing; without
    docs there are no rows.  No shuffle of documents: rows are independent.
    """
    forest = fit(labelled_findings(docs.sparkSession) if labelled is None else labelled)
    out = judged(candidates(docs, id_col, text_col, path_col), forest)
    return out.select(id_col, "word_index", "nth", F.length("value").alias("value_length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def redact(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with every secret of a text replaced by mark, in all its places that no further letter, digit or +/_- adjoins; the other rows and columns stay as they are.

    Secrets are gathered per id and text, so a row, also one without an id, loses only its own.
    """
    forest = fit(labelled_findings(docs.sparkSession) if labelled is None else labelled)
    found = judged(candidates(docs, id_col, text_col, path_col), forest).where("is_secret")
    values = cut(found.groupBy(F.col(id_col).alias("_id"), F.col("text_key").alias("_text_key")).agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("_values")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_key"), F.md5(text_col).alias("_md5"))
    joined = whole.join(hinted(values), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_md5") == F.col("_text_key")), "left")
    text = F.col("_row").getField(text_col)
    alone = lambda value: F.concat(F.lit(r"(?<![A-Za-z0-9+/_\-])"), F.regexp_replace(value, r"([^A-Za-z0-9])", r"\\$1"), F.lit(r"(?![A-Za-z0-9+/_\-])"))
    clean = F.coalesce(F.aggregate("_values", text, lambda rest, value: F.regexp_replace(rest, alone(value), F.lit(mark))), text)
    return joined.select(*[clean.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
