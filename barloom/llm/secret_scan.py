"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions and
Spark ML's own trees only; no Python runs on the executors.

Candidates are runs of 16 or more characters of the alphabets that keys use, and values of 4 or more characters that are
assigned to a credential's name, whatever they are made of. The forest reads the
candidate's length, character transitions, dictionary coverage, path likeness and neighbouring words. It is
trained from labelled findings, a table (candidate, before, after, is_secret). Callers may bring their own; by default
they are ``made_labels``: values drawn by published credential formats and everyday look-alikes, set between words of the
corpus, so that their labels are known by how they were made and not by a pattern over the texts that are scanned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Fixed: words beside real credentials, and words beside look-alikes.
_NAMES = r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)s?"
CREDENTIAL_WORDS = rf"(?i)\b{_NAMES}\b"
LOOKALIKE_WORDS = r"(?i)\b(?:commit|sha1|sha256|md5|checksum|digest|uuid|revision|etag|integrity|example|placeholder|sample)\b"
#: A credential's name with what assigns a value to it; the value follows.
PREFIX = rf"(?i:{_NAMES}[\"']?[ \t]{{0,4}}[:=][ \t]{{0,4}}[\"'`]?)"
CANDIDATE = rf"{PREFIX}[^\s\"'`]{{4,}}|[A-Za-z0-9+/_\-.@]{{16,}}={{0,2}}"
#: Made labels of each kind; words of the dictionary, at most; characters of context.
SAMPLES_PER_KIND, DICTIONARY_WORDS, CONTEXT = 400, 300, 48
_LEAST, _BLOCK = 4, 64
FEATURES = (
    "length", "digits", "uppers", "transitions", "kinds", "vowel_runs", "hex", "dictionary", "slashes", "extension", "at_sign",
    "credential_word", "lookalike_word", "assigned", "quoted", "repeats", "ascending", "padded",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _joined(first: Column, second: Column) -> Column:
    """The strings of two equally long arrays in turn, as one string."""
    return F.array_join(F.flatten(F.zip_with(first, second, lambda a, b: F.array(a, b))), "")


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, start (code points from 0), candidate, before, after: one row per occurrence in whole texts.

    A text is cut at its candidates once, and a candidate's place is summed up by blocks, so the cost grows with the text's length
    (and the square of its candidates over 64, in copied numbers). A candidate's context is put together from the cuts beside
    it and may hold other candidates. No more than four blanks stand on either side of what assigns a value. Null and empty texts have none. Repeated
    rows repeat their findings. Other columns aren't read.
    """
    text = F.col("text")
    cuts = docs.where(text.rlike(CANDIDATE)).select(
        "doc_id", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("parts")
    )
    lengths = F.zip_with("parts", "found", lambda p, c: (F.char_length(p) + F.coalesce(F.char_length(c), F.lit(0))).cast("long"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)

    def before_blocks(lengths: Column) -> Column:
        """Where each block of _BLOCK candidates begins: sums over blocks, then over those."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("found") - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
        return F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    # A candidate has at least _LEAST characters: so many of them and the cuts between fill any context.
    reach = -(-CONTEXT // _LEAST)

    def context(i: Column, lengths: Column, blocks: Column) -> Column:
        block, inside = F.floor((i - 1) / _BLOCK).cast("int"), (i - 1) % _BLOCK
        start = F.element_at(blocks, block + 1) + total(F.slice(lengths, block * _BLOCK + 1, inside)) + F.char_length(F.element_at("parts", i))
        k = F.least(F.lit(reach), i - 1)
        match = F.element_at("found", i)
        name = F.regexp_extract(match, f"^{PREFIX}(?=[^\\s\"'`]{{4}})", 0)
        before = F.concat(_joined(F.slice("parts", i - k, k), F.slice("found", i - k, k)), F.element_at("parts", i), name)
        after = F.concat(F.element_at("parts", i + 1), _joined(F.slice("found", i + 1, F.lit(reach)), F.slice("parts", i + 2, F.lit(reach))))
        size = F.char_length(name)
        return F.struct(
            (start + size).cast("long").alias("start"), F.substring(match, size + 1, F.char_length(match)).alias("candidate"),
            F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"),
        )

    # An array of one binds a value to a name, so that it is made once a text and not once a candidate.
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    every = bound(lengths, lambda n: bound(before_blocks(n), lambda b: F.transform(F.sequence(F.lit(1), F.size("found")), lambda i: context(i, n, b))))
    rows = cuts.select("doc_id", F.explode(every).alias("f"))
    return rows.select("doc_id", "f.start", "f.candidate", "f.before", "f.after")


def dictionary(docs: DataFrame) -> list[str]:
    """The most frequent words of 4 letters or more in all documents, at most DICTIONARY_WORDS; counted partially before
    the shuffle."""
    words = docs.where("text IS NOT NULL").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where(F.char_length("w") >= 4)
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY_WORDS).collect()]


def with_features(found: DataFrame, words: list[str], name: str = "features") -> DataFrame:
    c = F.col("candidate")
    size = F.char_length(c).cast("double")
    known = "(?i)" + "|".join(sorted((w for w in words if w.isalpha()), key=lambda w: (-len(w), w))) if words else r"\z\A"
    covered = (size - F.char_length(F.regexp_replace(c, known, ""))) / size
    flag = lambda test: test.cast("double")
    kinds = flag(c.rlike("[a-z]")) + flag(c.rlike("[A-Z]")) + flag(c.rlike("[0-9]")) + flag(c.rlike(r"[+/_\-.@=]"))
    values = {
        "length": size, "digits": _count(c, "[0-9]") / size, "uppers": _count(c, "[A-Z]") / size,
        "transitions": _count(c, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])") / size, "kinds": kinds,
        "vowel_runs": _count(c, "(?i)[bcdfghjklmnpqrstvwxz]{1,3}[aeiouy]{1,2}") / size, "hex": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "dictionary": covered, "slashes": _count(c, "[/.]") / size, "extension": flag(c.rlike(r"\.[A-Za-z]{2,5}$")), "at_sign": flag(c.contains("@")),
        "credential_word": flag(F.col("before").rlike(CREDENTIAL_WORDS)), "lookalike_word": flag(F.col("before").rlike(LOOKALIKE_WORDS)),
        "assigned": flag(F.col("before").rlike(r"[:=]\s*[\"']?$")), "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "repeats": _count(c, r"(.)\1\1") / size, "ascending": _count(c, "012|123|234|345|456|567|678|789|abc|bcd|cde|xyz") / size, "padded": flag(c.endswith("=")),
    }
    return found.withColumn(name, F.array(*(F.coalesce(values[f], F.lit(0.0)) for f in FEATURES)))


_HEX, _LOWER, _DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_UPPER = _LOWER.upper()
_LETTERS = _LOWER + _UPPER
_ANY = _LETTERS + _DIGITS
#: Fixed: formats of credentials and of what looks like them. {w}, {W} and {U} are words of the corpus, {alphabet:length} a drawn string.
#: Each kind is (before, value, after, is_secret); kinds of ``HELD_OUT`` teach nothing and serve to judge a forest.
KINDS = {
    "hex_token": ('{w} {w} token = "', "{hex:40}", '" {w}', 1), "hex_secret": ("{w} secret: ", "{hex:32}", " {w} {w}", 1),
    "api_key": ('{w} api_key="', "{any:32}", '" {w}', 1), "access_key": ("access_key = ", "AKIA{up:16}", "\n{w}", 1),
    "base64_secret": ('{w} secret_key: "', "{b64:40}", '" {w}', 1), "bearer": ("{w} Authorization: Bearer ", "{any:24}.{any:40}.{any:43}", " {w}", 1),
    "short_password": ('{w} password = "', "{w}{num:3}{sign:1}", '" {w}', 1), "mixed_password": ("pwd: ", "{any:6}{sign:1}{any:4}", " {w}", 1),
    "prefixed_token": ("{w} {w} ", "ghp_{any:36}", " {w}", 1), "bare_key": ("{w} key {w} ", "{any:44}", " {w}", 1),
    "commit": ("{w} commit ", "{hex:40}", " {w} {w}", 0), "checksum": ("sha256: ", "{hex:64}", " {w}", 0), "uuid": ("{w} ", "{hex:8}-{hex:4}-{hex:4}-{hex:4}-{hex:12}", " {w}", 0),
    "path": ("{w} /", "{w}/{w}/{w}/{w}.txt", " {w}", 0), "domain": ("{w} https://", "www.{w}.{w}.com/{w}/{w}", " {w}", 0), "mail": ("{w} ", "{w}.{w}.{w}@{w}.org", " {w}", 0),
    "compound": ("{w} {w} ", "{w}{w}{w}{w}", " {w}", 0), "sentence": ("{w} {w}. ", "{W}{w}{w}{w}", " {w}", 0), "last_word": ("{w} ", "{w}{w}{w}{w}.", " {W}", 0),
    "shout": ("{U}!! {U} ", "{U}{U}{U}{U}", ". {U}", 0), "camel": ("{w} ", "{w}{W}{W}{W}", "({w})", 0), "hyphens": ("{w} ", "{w}-{w}-{w}-{w}", ". {w}", 0), "underscores": ("{w} ", "{w}_{w}_{w}_{w}", " = {w}", 0),
    "number": ("{w} ", "{num:20}", " {w}", 0), "rule": ("{w} ", "----------------------------", " {w}", 0), "dotted": ("{w} ", "{num:3}.{num:3}.{num:3}.{num:6}", " {w}", 0),
    "prose": ("{w} secret: ", "{w}", " {w} {w}", 0), "prose_token": ("each token: ", "{w}", ", {w} {w}", 0), "placeholder": ("example {w} password = ", "xxxxxxxx", " {w}", 0),
    "slack_token": ('{w} token: "', "xoxb-{num:12}-{any:24}", '" {w}', 1), "digest": ("{w} md5 ", "{hex:32}", " {w}", 0), "long_path": ("{w} ", "{w}/{w}/{w}-{num:4}/{w}.html", " {w}", 0),
    "credential": ("credential = '", "{any:12}{sign:1}{any:8}", "' {w}", 1), "image": ("{w} src=", "{w}_{w}_{num:8}.png", " {w}", 0),
}
HELD_OUT = ("slack_token", "digest", "long_path", "credential", "image")
_ALPHABETS = {"hex": _HEX, "any": _ANY, "up": _UPPER + _DIGITS, "b64": _ANY + "+/", "num": _DIGITS, "sign": "!?%&*"}


def _drawn(alphabet: str, length: int, *salt: Column | str) -> Column:
    one = lambda i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(*salt, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), one), "")


def _made(template: str, words: Column, size: int, *salt: Column | str) -> Column:
    """A template filled in: every place draws by its own hash of the row."""
    parts, place = [], 0
    for piece in template.replace("{", "\x00{").replace("}", "}\x00").split("\x00"):
        if piece in ("{w}", "{W}", "{U}"):
            place += 1
            word = F.element_at(words, (F.pmod(F.xxhash64(*salt, F.lit(place)), F.lit(size)) + 1).cast("int"))
            parts.append({"{w}": word, "{W}": F.initcap(word), "{U}": F.upper(word)}[piece])
        elif piece.startswith("{"):
            alphabet, length = piece[1:-1].split(":")
            place += 1
            parts.append(_drawn(_ALPHABETS[alphabet], int(length), *salt, F.lit(place)))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def made_labels(spark: SparkSession, words: list[str], each: int = SAMPLES_PER_KIND, seed: int = 3) -> DataFrame:
    """kind, candidate, before, after, is_secret, held_out: ``each`` labelled findings of every kind of ``KINDS``, their words
    drawn from ``words`` (the corpus's dictionary). Bounded by the kinds and ``each``; reruns agree."""
    words = words or ["word"]
    base = spark.range(0, each, 1, 1).withColumn("words", F.array(*(F.lit(w) for w in words)))

    def one(kind: str) -> DataFrame:
        before, value, after, secret = KINDS[kind]
        fill = lambda t, part: _made(t, F.col("words"), len(words), F.lit(seed), F.lit(kind), F.lit(part), "id")
        return base.select(
            F.lit(kind).alias("kind"), fill(value, "value").alias("candidate"), F.right(fill(before, "before"), F.lit(CONTEXT)).alias("before"),
            fill(after, "after").alias("after"), F.lit(float(secret)).alias("is_secret"), F.lit(kind in HELD_OUT).alias("held_out"),
        )

    return reduce(DataFrame.unionByName, map(one, KINDS))


def fit(labelled: DataFrame, words: list[str]) -> RandomForestClassificationModel | None:
    """A forest from ``labelled`` (candidate, before, after, is_secret); None if both classes aren't there."""
    rows = stored(with_features(labelled, words).select("is_secret", "features").coalesce(4), "labelled")
    if rows.agg(F.countDistinct("is_secret")).first()[0] < 2:
        return None
    train = rows.select(F.col("is_secret").cast("double").alias("label"), array_to_vector("features").alias("features"))
    return RandomForestClassifier(numTrees=20, maxDepth=6, seed=5, minInstancesPerNode=2, featureSubsetStrategy="sqrt").fit(train)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every finding in ``docs`` with its score and the verdict: doc_id, start, candidate, before, after, score, is_secret.

    A score at the threshold is a secret. Without a forest (no labels of both classes) every finding stays, with score 1.
    ``labelled`` findings replace the made ones. An empty table gives an empty table.
    """
    found = stored(findings(docs), "findings")
    words = dictionary(docs)
    model = fit(made_labels(docs.sparkSession, words).where("NOT held_out") if labelled is None else labelled, words)
    if model is None:
        return found.select("*", F.lit(1.0).alias("score"), F.lit(True).alias("is_secret"))
    return judge(found, model, words, threshold)


def judge(found: DataFrame, model: RandomForestClassificationModel, words: list[str], threshold: float = 0.5) -> DataFrame:
    """``found`` with the forest's score and whether it reaches the threshold."""
    rows = with_features(found, words, "raw").withColumn("features", array_to_vector("raw"))
    judged = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return judged.select(*found.columns, "score", (F.col("score") >= threshold).alias("is_secret"))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", F.char_length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
