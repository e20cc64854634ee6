"""Secret scans: a random forest removes false positives from candidate findings. DataFrame functions only.

1. :func:`candidates`: parts of a text that could be credentials (runs of at least eight characters with a digit, or whatever a
   credential word is assigned or a URL gives as password), with the words around them. A word without white space inside, such as minified
   JSON or a query string, has as many as it has values, each with its own key.
2. :func:`features`: length, shares of character classes and changes between them, how usual the pairs of adjacent letters are,
   how much of the candidate is made of dictionary words, marks of paths, addresses and numbers, and the words around it. Dictionary and
   letter pairs are counted over all texts.
3. :func:`train`: a random forest on labelled findings (columns of a candidate and ``is_secret``). Without any of both kinds there
   is no forest and every candidate stays a finding. :func:`labelled_findings` makes labels where there is no better source: formats that
   issuers or standards fix, and derived counter-examples (ordinary words as placeholders, digests as keys), from at most
   ``FIT_DOCS`` documents.
4. :func:`scan` gives every candidate a probability; :func:`redact` replaces the secrets found in each text.

Defined cases: null and empty texts have no candidates; repeated rows are scanned each, and give equal findings; a null key is a
key of its own; an empty table gives no findings. ``redact`` returns the columns of its input.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.llm.common import own
from draftloom.session import checkpoint

#: Documents that labels are made from, at most (about; drawn by hash), trees and depth of the forest, and its threshold.
FIT_DOCS, TREES, DEPTH, THRESHOLD = 20_000, 24, 8, 0.5
#: A dictionary word occurs in at least this share of all documents, and in two.
DICTIONARY_SHARE = 2e-6
MASK = "[SECRET]"
#: A secret of this many characters, with a digit, is replaced wherever its text holds it.
CERTAIN = 12
# Words that announce a credential, and words that announce a made-up one.
CREDENTIAL = "password|passwd|pwd|passphrase|secret|token|apikey|api_key|api-key|access_key|access-key|accesskey|auth|authorization|bearer|credential|credentials|private_key|client_secret|key"
MADE_UP = "example|examples|sample|dummy|test|tests|fake|placeholder|changeme|your|xxx|todo|mock|demo|fixture|doc|docs"
# Formats of keys that an issuer prescribes, and of numbers and addresses that are no secrets.
ISSUED = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{35}$|^sk_(live|test)_[0-9a-zA-Z]{16,}$|^eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
NO_SECRET = (r"^[\w.+%-]+@[\w-]+(\.[\w-]+)+$|^\d{1,3}(\.\d{1,3}){3}$|^\d{12,19}$|^[\d().+ -]{7,}$|^v?\d+(\.\d+)+$|^\d{4}-\d{2}-\d{2}"
             r"|^[a-z]+(\.[a-z0-9-]+)*\.(com|org|net|edu|gov|io)(/.*)?$|^[\w.-]+/[\w./-]+\.[a-z]{1,4}$")
# A key ends with its assignment and what opens the value.
ASSIGNED = r"[=:]>?[\\\"'`(\[<{]*$"
_SPLIT = r"[\x20\x09-\x0D]+"
_KEY = r"[0-9]{0,8}[A-Za-z_][A-Za-z0-9_.@$!+~%/-]{0,200}\\*[\"'`]?(?::=|=>|[=:]{1,2})[\\\"'`(\[<{]*"
_CORE = r"[A-Za-z0-9](?:[A-Za-z0-9+/_~.@%$!-]{2,}[A-Za-z0-9]|[A-Za-z0-9]{3,})(?:={1,2}(?![A-Za-z0-9\"'`]))?"
# A password in a URL: where it begins gets a mark, and the @ behind it ends the word.
_URL, _URL_MARKED = r"(://[^\s/:@\"'`]{0,100}:)([^\s/\"'`]{3,200})@", "$1\x01$2 "
_FOUND = rf"(://[^\s/:@\"'`]{{0,100}}:\x01|{_KEY}|)({_CORE})"
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
COLUMNS = ["candidate", "own_key", "before_2", "before", "after", "path"]
FEATURES = ["length", "digits", "upper", "lower", "other", "changes", "pairs", "covered", "longest_run", "slashes", "dots", "ats", "dashes", "hex", "assigned", "credential", "made_up", "path_made_up"]


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(key, place, candidate, own_key, before_2, before, after, path): candidates by place of their word in the text; a word can hold several."""
    hint = F.col(text).rlike("[0-9=]|://[^/]*:|(?i)(" + CREDENTIAL + ")[^a-z]{0,3}:")
    words = docs.where(hint).select(F.col(key).alias("key"), (F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))).alias("path"),
                                    F.split(text, _SPLIT).alias("w"))
    # A word with a digit, a word with an assignment in it, or what follows an assignment.
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).rlike("[0-9]|[A-Za-z]\\\\*[\"'`]?[=:]{1,2}>?[\\\\\"'`(\\[<{]*[A-Za-z]|://[^/]*:") | F.coalesce(F.get("w", i - 1).rlike("(?i)(" + CREDENTIAL + ")?[\"']?[=:]+$"), F.lit(False)))

    def near(i: Column, by: int) -> Column:
        return F.coalesce(F.when(i + by >= 0, F.get("w", i + by)), F.lit(""))

    found = words.select("key", "path", F.explode(F.transform(places, lambda i: F.struct(
        i.alias("place"), F.get("w", i).alias("word"), near(i, -2).alias("before_2"), near(i, -1).alias("before"), near(i, 1).alias("after")))).alias("c")).select("key", "path", "c.*")
    found = found.withColumn("word", F.regexp_replace("word", _URL, _URL_MARKED))
    both = F.arrays_zip(F.regexp_extract_all("word", F.lit(_FOUND), 1).alias("own_key"), F.regexp_extract_all("word", F.lit(_FOUND), 2).alias("candidate"))
    found = found.withColumn("m", F.explode(both)).select("key", "path", "place", "before_2", "before", "after", F.translate("m.own_key", "\x01", "").alias("own_key"), "m.candidate")
    announced = F.col("own_key").rlike(f"(?i)({CREDENTIAL})|://") | (F.col("before").rlike("[=:]$") & F.concat("before_2", "before").rlike(f"(?i)({CREDENTIAL})"))
    fine = F.when(announced, F.length("candidate") >= 4).otherwise((F.length("candidate") >= 8) & F.col("candidate").rlike("[0-9]"))
    return found.where(fine).select("key", "place", *COLUMNS)


def dictionary(docs: DataFrame, text: str = "text", share: float = DICTIONARY_SHARE) -> DataFrame:
    """(word, n): lower-case words of letters and in how many texts they occur, over all texts."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))).alias("word")).where("length(word) between 3 and 24")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    # The share of the most frequent word's count stands for that of all documents.
    most = counted.agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(most), F.col("n") >= share * F.col("most")).select("word", "n")


def features(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add the columns of ``FEATURES``; ``lexicon`` is what :func:`dictionary` returns."""
    kinds = found.select("candidate").distinct()
    size = F.length("candidate").cast("double")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace("candidate", pattern, "")).cast("double")

    classes = F.translate("candidate", _LOWER + _UPPER + _DIGIT, "a" * 26 + "A" * 26 + "0" * 10)
    runs = F.regexp_extract_all(F.lower("candidate"), F.lit(r"([\p{L}]{3,})"), 1)
    digit_runs = F.regexp_extract_all("candidate", F.lit(r"([0-9A-Za-z]+)"), 1)
    plain = kinds.select(
        "candidate", size.alias("length"), ((size - share("[0-9]")) / size).alias("digits"), ((size - share("[A-Z]")) / size).alias("upper"), ((size - share("[a-z]")) / size).alias("lower"),
        (share("[0-9A-Za-z]") / size).alias("other"), ((F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / size).alias("changes"),
        F.aggregate(digit_runs, F.lit(0), lambda a, x: F.greatest(a, F.length(x))).cast("double").alias("longest_run"),
        (size - share("[/\\\\]")).alias("slashes"), (size - share("[.]")).alias("dots"), (size - share("@")).alias("ats"), (size - share("[_-]")).alias("dashes"),
        F.col("candidate").rlike("^[0-9a-f]{12,}$|^[0-9A-F]{12,}$").cast("double").alias("hex"))
    # Dictionary words within a candidate, and how usual its pairs of letters are.
    parts = kinds.select("candidate", F.explode(runs).alias("word"))
    known = parts.join(lexicon.select("word"), "word").groupBy("candidate").agg(F.sum(F.length("word")).cast("double").alias("known"))
    letters = lexicon.select("n", F.col("word").alias("w")).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, 2))).alias("pair"))
    pairs = letters.groupBy("pair").agg(F.sum("n").cast("double").alias("m"))
    lowered = kinds.withColumn("c", F.lower("candidate")).where("length(c) > 1")
    own_pairs = lowered.select("candidate", F.explode(F.transform(F.sequence(F.lit(1), F.length("c") - 1), lambda i: F.substring("c", i, 2))).alias("pair"))
    usual = own_pairs.join(pairs, "pair", "left").groupBy("candidate").agg(F.avg(F.log1p(F.coalesce("m", F.lit(0.0)))).alias("pairs"))
    described = plain.join(usual, "candidate", "left").join(known, "candidate", "left")
    described = described.withColumn("covered", F.coalesce(F.col("known") / F.col("length"), F.lit(0.0))).withColumn("pairs", F.coalesce("pairs", F.lit(0.0))).drop("known")
    around = F.lower(F.concat_ws(" ", "own_key", "before_2", "before"))
    placed = found.withColumns({
        "assigned": (F.col("own_key").rlike(ASSIGNED) | F.col("before").rlike("[=:]$")).cast("double"),
        "credential": (around.rlike(f"(^|[^a-z])({CREDENTIAL})([^a-z]|$)") | F.col("own_key").rlike("://")).cast("double"),
        "made_up": F.lower(F.concat_ws(" ", "own_key", "before_2", "before", "candidate", "after")).rlike(f"(^|[^a-z])({MADE_UP})([^a-z]|$)").cast("double"),
        "path_made_up": F.lower("path").rlike(f"(^|[^a-z])({MADE_UP})([^a-z]|$)").cast("double")})
    return placed.join(described, "candidate")


def labelled_findings(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", most: int = FIT_DOCS) -> DataFrame:
    """(candidate, own_key, before_2, before, after, path, is_secret) from about ``most`` documents, drawn by hash.

    Candidates with a prescribed format speak for themselves. The rest is derived: ordinary words of the drawn texts behind credential
    words are placeholders, digests of their keys in several spellings are secrets, digests behind other words are none.
    """
    n = docs.count()
    rate = min(1.0, most / max(1, n))

    def drawn(column: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("fit"), F.col(column).cast("string")), F.lit(1_000_003)) < F.lit(int(rate * 1_000_003))

    assigned = F.concat_ws(" ", "own_key", "before_2", "before").rlike(f"(?i)({CREDENTIAL})|://") & (F.col("own_key").rlike(ASSIGNED) | F.col("before").rlike("[=:]$"))
    rule = F.when(F.col("candidate").rlike(ISSUED), 1.0).when(F.col("candidate").rlike(NO_SECRET), 0.0).when(
        assigned & F.col("candidate").rlike("^[0-9a-fA-F]{16,}$|^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/=_-]{16,}$"), 1.0)
    seen = found.where(drawn("key")).withColumn("is_secret", rule).where("is_secret is not null").select(*COLUMNS, "is_secret")
    # Three words of each drawn text, from places that its key picks.
    words = F.filter(F.split(text, _SPLIT), lambda w: F.length(w) >= 4)
    h = F.md5(F.concat_ws("|", F.lit("secret"), F.col(key).cast("string")))
    base = docs.where(drawn(key)).select(words.alias("w"), h.alias("h"), F.sha1(F.col(key).cast("string").cast("binary")).alias("s"),
                                         F.pmod(F.xxhash64(F.lit("form"), F.col(key).cast("string")), F.lit(8)).alias("form")).where("size(w) >= 3")

    def word(i: int) -> Column:
        return F.get("w", F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.size("w"), F.lit(1))).cast("int"))

    base = base.select("h", "s", "form", word(1).alias("a"), word(2).alias("b"), word(3).alias("c"))
    plain = F.regexp_replace("a", r"[^\p{L}]", "")
    key_word = F.element_at(F.array(*[F.lit(x) for x in ("password=", "token", "secret:", "api_key=", "AUTH_TOKEN=", "passwd:", "client_secret=", "key:")]), (F.col("form") + 1).cast("int"))
    spaced = F.col("form") == 1
    spelled = F.when(F.col("form") % 4 == 0, F.substring("h", 1, 18)).when(F.col("form") % 4 == 1, F.col("s")).when(F.col("form") % 4 == 2, F.substring(F.base64(F.unhex("s")), 1, 24)).otherwise(
        F.upper(F.concat(F.substring("h", 1, 10), F.substring("s", 1, 12))))

    def example(candidate: Column, own_key: Column, before_2: Column, before: Column, is_secret: float) -> DataFrame:
        return base.select(candidate.alias("candidate"), own_key.alias("own_key"), before_2.alias("before_2"), before.alias("before"), F.col("c").alias("after"), F.lit("").alias("path"),
                           F.lit(is_secret).alias("is_secret")).where("length(candidate) >= 4")

    own_key, before = F.when(spaced, F.lit("")).otherwise(key_word), F.when(spaced, F.lit("=")).otherwise(F.col("b"))
    before_2 = F.when(spaced, F.lit("token")).otherwise(F.col("c"))
    made = example(spelled, own_key, before_2, before, 1.0).unionByName(example(plain, own_key, before_2, before, 0.0))
    made = made.unionByName(example(F.concat(plain, F.lit("."), F.substring(F.translate("h", "abcdef", "123456"), 1, 2), F.lit("-"), F.lower("c")), F.lit(""), F.col("b"), F.col("a"), 0.0))
    made = made.unionByName(example(F.concat(F.lit("AKIA"), F.upper(F.substring("s", 1, 16))), F.lit(""), F.col("b"), F.col("a"), 1.0).where("crc32(candidate) % 4 = 0"))
    return seen.unionByName(made)


def train(labelled: DataFrame, lexicon: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> RandomForestClassificationModel | None:
    """A forest on labelled findings; None if one of both kinds is missing. Rows are what the caller bounds."""
    described = checkpoint(features(labelled, lexicon).select("is_secret", *FEATURES))
    kinds = described.select("is_secret").distinct().count()
    if kinds < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)
    return RandomForestClassifier(labelCol="is_secret", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(key, place, candidate, probability, is_secret): every candidate of every text and what the forest says of it."""
    found = checkpoint(candidates(docs, key, text, path))
    lexicon = checkpoint(dictionary(docs, text))
    model = train(labelled_findings(docs, found, key, text) if labelled is None else labelled, lexicon)
    if model is None:
        return found.select(F.col("key").alias(key), "place", "candidate", F.lit(1.0).alias("probability"), F.lit(True).alias("is_secret"))
    # Equal findings get equal answers: the forest sees each kind once.
    kinds = found.groupBy(*COLUMNS).agg(F.count(F.lit(1)).alias("n")).drop("n")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(kinds, lexicon))
    said = model.transform(rows).select(*COLUMNS, vector_to_array("probability")[1].alias("probability"))
    joined = found.join(said, COLUMNS)
    return joined.select(F.col("key").alias(key), "place", "candidate", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def _masked(word: Column, hidden: Column, mask: str) -> Column:
    """A word with those of its candidates that ``hidden`` lists replaced; keys and what lies between stay."""
    marked = F.regexp_replace(word, _URL, _URL_MARKED)

    def plain(part: Column) -> Column:
        return F.translate(part, " \x01", "@")

    between = F.split(marked, _FOUND, -1)
    found = F.arrays_zip(F.regexp_extract_all(marked, F.lit(_FOUND), 1).alias("k"), F.regexp_extract_all(marked, F.lit(_FOUND), 2).alias("c"), F.slice(between, F.lit(2), F.size(between)).alias("b"))
    rest = F.transform(found, lambda m: F.concat(plain(m["k"]), F.when(F.array_contains(hidden, m["c"]), F.lit(mask)).otherwise(plain(m["c"])), plain(m["b"])))
    # A word that holds the mark of URL passwords itself is not taken apart.
    return F.when(F.contains(word, F.lit("\x01")), F.aggregate(hidden, word, lambda t, s: F.replace(t, s, F.lit(mask)))).otherwise(F.concat(plain(F.get(between, F.lit(0))), F.array_join(rest, "")))


def redact(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str | None = "source", mask: str = MASK, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every secret in their texts replaced by ``mask``; ``n_chars``, where there is one, follows the text.

    A secret is replaced at its place: in the word where it was found, as a whole value (equal values of one word together). One of at
    least ``CERTAIN`` characters with a digit, which no other text holds by chance, goes wherever it occurs in that text. What is found
    belongs to a key and its text, so rows that share a key, or have none, do not clean each other.
    """
    secrets, again, words, gaps, joined = own("secrets"), own("key"), own("words"), own("gaps"), own("joined")
    name = F.concat_ws("/", F.coalesce(F.col(key).cast("string"), F.lit("")), F.hex(F.xxhash64(text)))
    found = scan(docs.withColumn(again, name), labelled, again, text, path, threshold).where("is_secret")
    certain = (F.length("candidate") >= CERTAIN) & F.col("candidate").rlike("[0-9]")
    placed = found.groupBy(again, "place").agg(F.collect_set(F.when(~certain, F.col("candidate"))).alias("hidden"), F.collect_set(F.when(certain, F.col("candidate"))).alias("certain"))
    # Longer secrets first, so that none is cut by one that it contains.
    longest = F.array_sort(F.array_distinct(F.flatten(F.collect_list("certain"))), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    per_text = placed.groupBy(again).agg(F.array_sort(F.collect_list(F.when(F.size("hidden") > 0, F.struct("place", "hidden")))).alias("placed"), longest.alias("certain"))
    per_text = checkpoint(per_text.select(again, F.struct("placed", "certain").alias(secrets)))
    rows = docs.withColumn(again, name).join(per_text, again, "left")
    # Words and the white space behind them, of texts with a secret to be replaced at its place.
    at = F.col(f"{secrets}.placed")
    some = F.coalesce(F.size(at) > 0, F.lit(False))
    rows = rows.withColumn(words, F.when(some, F.split(text, _SPLIT, -1))).withColumn(gaps, F.when(some, F.concat(F.regexp_extract_all(text, F.lit(f"({_SPLIT})"), 1), F.array(F.lit("")))))
    rows = rows.withColumn(joined, F.when(some, F.zip_with(words, gaps, lambda w, g: F.concat(w, g))))
    # Each secret's word comes behind the stretch since the one before.
    stretches = F.transform(at, lambda s, i: F.concat(
        F.array_join(F.slice(joined, F.coalesce(F.when(i > 0, F.get(at, i - 1)["place"]), F.lit(-1)) + 2, s["place"] - F.coalesce(F.when(i > 0, F.get(at, i - 1)["place"]), F.lit(-1)) - 1), ""),
        _masked(F.get(words, s["place"]), s["hidden"], mask), F.get(gaps, s["place"])))
    tail = F.array_join(F.slice(joined, F.get(at, F.size(at) - 1)["place"] + 2, F.size(joined)), "")
    cleaned = F.when(some, F.concat(F.array_join(stretches, ""), tail)).otherwise(F.col(text))
    cleaned = F.when(F.col(secrets).isNull(), F.col(text)).otherwise(F.aggregate(F.col(f"{secrets}.certain"), cleaned, lambda t, s: F.replace(t, s, F.lit(mask))))
    out = rows.withColumn(text, cleaned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(secrets).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
