"""Secret scans: patterns propose candidates, a random forest removes the false positives.

Candidates are runs of 16 or more token characters with a digit and a letter, values of 8 or more
characters behind a name and `=`, values of any shape from 7 characters behind an assignment to a telling
name, passwords in URLs, and keys of known formats. The forest sees a candidate's length, the transitions between its character
classes, the share of it that dictionary words cover, whether it looks like a path, an address or a
digest, and the neighbouring words. It learns from labelled findings; labelled_findings() makes a bounded
set of them from a rule, and a table of reviewed findings can take its place.

Everything on the main path is column expressions; only the forest's training gathers rows, those of the
labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm.common import free_name, table, written

#: Labelled findings that the forest is fitted on, at most.
FINDINGS = 6000
TREES, DEPTH, SEED = 24, 7, 7
#: Characters before and after a candidate that count as its neighbourhood.
NEAR = 48
REDACTED = "[SECRET]"
#: Bytes of secrets' places that are broadcast; beyond, they meet their texts in a shuffled join.
BROADCAST = 32 << 20
#: A mark that texts don't hold; where one does, it counts as a space while searching.
_MARK = "\x01"

# What candidates look like, names that tell of secrets, and everyday words.
_MIXED = r"(?=[A-Za-z+/_.@-]*+[0-9])(?=[0-9+/_.@-]*+[A-Za-z])"
CANDIDATE = r"(?<![A-Za-z0-9+/_.@-])" + _MIXED + r"[A-Za-z0-9+/_.@-]{16,}+={0,2}"
_PEM = r"-----(?:BEGIN|END) [A-Z0-9 ]*+(?<=PRIVATE KEY|PRIVATE KEY BLOCK)-----"
_BODY = r"[A-Za-z0-9+/=\s:,.]*+"
PEM = _PEM.replace("(?:BEGIN|END)", "BEGIN") + rf"(?:{_BODY}(?:-(?!-){_BODY})*+" + _PEM.replace("(?:BEGIN|END)", "END") + ")?"
KNOWN = (
    r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}+|github_pat_[A-Za-z0-9_]{30,}+|glpat-[A-Za-z0-9_-]{20,}+|hf_[A-Za-z0-9]{30,}+|npm_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}"
    r"|sk_(?:live|test)_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
)
# Names that tell of secrets: some inside longer words, the others as whole parts of a name (my_token, authToken, AUTH-TOKEN, but not author or secretary).
_INSIDE = r"passw(?:or)?ds?|passphrases?|api[_-]?keys?|access[_-]?keys?|private[_-]?keys?|secret[_-]?keys?"
_PARTS = ("tokens?", "secrets?", "auth", "authorization", "credentials?", "pwd", "bearer")
_PART = "|".join((
    rf"(?<![A-Za-z])(?:{'|'.join(_PARTS)})(?![a-z])",
    rf"(?:{'|'.join(p.capitalize() for p in _PARTS)})(?![a-z])",
    rf"(?<![A-Za-z])(?:{'|'.join(p.upper() for p in _PARTS)})(?![A-Z])",
))
TELLING = rf"(?:(?i:{_INSIDE})|{_PART})"
_NAME = rf"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++[\"'`]?\s{{0,3}}+[=:])[A-Za-z0-9_-]*?{TELLING}[A-Za-z0-9_-]*+"
_ASSIGN = r"[\"'`]?\s{0,3}(?:=>|:=|==?|:)\s{0,3}(?:(?i:bearer|basic)\s{1,3})?"
#: (what stands before, a candidate): the first that matches at the first place wins.
FORMS = [
    ("", PEM),
    (r"://[^\s:/@\"'<>]*+:", r"[^\s/@\"'<>]{6,}(?=@)"),
    (rf"(?<=[?&]){_NAME}=", r"[^\s&#\"'<>]{8,}+"),
    (rf"{_NAME}{_ASSIGN}\"", r"[^\"\r\n]{7,}+(?=\")"),
    (rf"{_NAME}{_ASSIGN}'", r"[^'\r\n]{7,}+(?=')"),
    (rf"{_NAME}{_ASSIGN}`", r"[^`\r\n]{7,}+(?=`)"),
    (rf"{_NAME}{_ASSIGN}[\"'`]?", r"[^\s\"'`]{6,}[^\s\"'`.,;:)\]}>]"),
    ("", KNOWN),
    (r"(?<![A-Za-z0-9+/_.@-])[A-Za-z0-9_.-]++=", _MIXED + r"[A-Za-z0-9+/_.@-]{8,}+={0,2}"),
    ("", CANDIDATE),
]
_FORM = "|".join(f"({before})({candidate})" for before, candidate in FORMS)
#: The forms that need no telling name, and those that need neither `=` nor `:`.
_UNNAMED = "|".join(before + candidate for before, candidate in FORMS if _NAME not in before)
_BARE = "|".join(candidate for before, candidate in FORMS if not before)
_MARKED = "".join(f"${2 * k + 1}" for k in range(len(FORMS))) + "\x01" + "".join(f"${2 * k + 2}" for k in range(len(FORMS))) + "\x01"
#: Parts of a text whose start is summed at a time.
BLOCK = 256
#: No candidate is shorter, so that NEAR characters hold less than NEAR / SHORTEST of them.
SHORTEST = 6
HARMLESS = r"(?i)(sha|md5|commit|digest|checksum|etag|uuid|guid|revision|example|sample|placeholder|dummy|test)"
WORDS = "about access account admin all and api app are auth base because build bytes cache check class client code com commit config content count data date default docs download en example example1 false file files first for from get group have hello home html http https image index info input issue item json key last lib line link list local main make message model module more name net new node not null number object of on one option order org output page part path people php png post product public query read release report request response root sample script search section server service session set site size source start static status string style system table tag temp test text that the their there this time title type update upload uri url use user username users util value version view web when which with word world www year you your disabled enabled required optional undefined unknown changed missing expired invalid redacted environ secrets settings variable provided rotated stored read never always information value".split()


def _held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows plus a column that comes from a generator: a plain one would be copied into the functions that read it, and computed for each element."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def candidates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, candidate, before, after): start counts code points from 0."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _MARK, " ")
    # between marks: plain, candidate, plain, candidate, ..., plain
    # all other forms need one of these signs, most of them a telling name: the long pattern is for texts that have them
    some = F.when(~F.rlike(text, F.lit("[=:]")), F.rlike(text, F.lit(_BARE))).when(F.rlike(text, F.lit(_NAME)), F.rlike(text, F.lit(_FORM))).otherwise(F.rlike(text, F.lit(_UNNAMED)))
    rows = _held(docs.where(some).select(key, text.alias("text")), "parts", F.split(F.regexp_replace("text", _FORM, _MARKED), _MARK)).drop("text")
    rows = _held(rows, "lengths", F.transform("parts", F.length))
    rows = _held(rows, "tails", F.transform("parts", lambda x: F.substring(x, F.greatest(F.lit(1), F.length(x) - NEAR + 1), F.lit(NEAR))))
    rows = _held(rows, "heads", F.transform("parts", lambda x: F.substring(x, 1, NEAR)))
    # where each block of parts begins; inside its block a part's start is summed anew
    sums = F.transform(F.sequence(F.lit(1), F.size("lengths"), F.lit(BLOCK)), lambda first: F.aggregate(F.slice("lengths", first, F.lit(BLOCK)), F.lit(0), lambda n, x: n + x))
    rows = _held(rows, "begins", F.aggregate(sums, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n))))
    at = F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2))
    near = 2 * -(-NEAR // SHORTEST) + 1  # parts that hold NEAR characters, if there are as many

    def before(i: Column) -> Column:
        joined = F.array_join(F.slice("tails", F.greatest(F.lit(1), i - near + 1), F.least(i, F.lit(near))), "")
        return F.substring(joined, F.greatest(F.lit(1), F.length(joined) - NEAR + 1), F.lit(NEAR))

    def start(i: Column) -> Column:
        block = F.floor(i / F.lit(BLOCK)).cast("int")
        return F.get("begins", block) + F.aggregate(F.slice("lengths", block * BLOCK + 1, i % BLOCK), F.lit(0), lambda n, x: n + x)

    found = F.transform(at, lambda i: F.struct(
        start(i).alias("start"), F.get("parts", i).alias("candidate"),
        before(i).alias("before"), F.substring(F.array_join(F.slice("heads", i + 2, F.lit(near)), ""), 1, NEAR).alias("after"),
    ))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*")


FEATURES = ["length", "digits", "uppers", "symbols", "changes", "distinct", "dictionary", "hex", "path", "address", "uuid", "telling", "assigned", "quoted", "harmless", "known"]


def _share(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.length(of)


def features(found: DataFrame) -> DataFrame:
    """found plus FEATURES, doubles, from candidate, before and after."""
    c, before = F.col("candidate"), F.col("before")
    in_url = F.rlike(before, F.lit(r"://[^\s:/@]*:$")) & F.startswith("after", F.lit("@"))
    words = "|".join(sorted((w for w in WORDS if len(w) >= 4), key=len, reverse=True))
    columns = {
        "length": F.length(c), "digits": _share("[0-9]", c), "uppers": _share("[A-Z]", c), "symbols": _share("[^A-Za-z0-9]", c),
        "changes": F.regexp_count(c, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / F.length(c),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), f"({words})", "")) / F.length(c),
        "hex": F.rlike(c, F.lit("^[0-9a-fA-F]+$")), "path": F.rlike(c, F.lit(r"/[A-Za-z0-9_-]+[/.]|\.[a-z]{2,4}$")), "address": F.contains(c, F.lit("@")),
        "uuid": F.rlike(c, F.lit("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")),
        "telling": F.rlike(before, F.lit(TELLING)), "assigned": F.rlike(before, F.lit(r"[=:]\s*[\"']?$")), "quoted": F.rlike(before, F.lit("[\"'`]$")),
        "harmless": F.rlike(before, F.lit(HARMLESS)), "known": F.rlike(c, F.lit(f"{KNOWN}|-----BEGIN")) | in_url,
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(candidate, before, after, label): findings that candidates() makes in n texts by rule from row numbers, half of them with a secret.

    Secrets: hexadecimal, base64 and prefixed keys behind an assignment to a telling name, a header or a
    sentence; passwords with and without symbols, letters or digits alone; query strings, bearer headers, URL
    credentials, private keys and bare keys of known formats. Others: addresses, digests and commits named
    as such, uuids, paths, versions, numbered words, placeholders, and words and settings behind a telling name.
    """
    rows = spark.range(0, n, 1, 4)
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "[=/]", "x")

    def word(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))

    def pick(*choices) -> Column:
        return F.element_at(F.array(*[c if isinstance(c, Column) else F.lit(c) for c in choices]), (F.pmod(F.xxhash64(i, F.lit(len(choices))), F.lit(len(choices))) + 1).cast("int"))

    size = F.element_at(F.array(*[F.lit(x) for x in (20, 24, 32, 40, 64)]), (F.pmod(F.xxhash64(i, F.lit(99)), F.lit(5)) + 1).cast("int"))
    secret = pick(F.substring(digest, F.lit(1), size), F.substring(digest, 1, 40), F.substring(base64, 1, 32), F.substring(base64, 1, 40), F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)), F.concat(F.lit("AKIA"), F.upper(F.substring(base64, 1, 16))), F.concat(F.lit("sk_live_"), F.substring(base64, 1, 24)))
    telling = F.concat(word(1), F.lit(" "), word(2), F.lit(" "), pick("token", "api_key", "secret", "password", "access_key", "auth_token", "API_KEY", "client_secret", "Secret"), pick(' = "', '="', ": ", "=", " = '", ': "', " "))
    plain = F.concat_ws(" ", word(3), word(4), word(5), F.lit(""))
    kind = F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(8))
    address = F.concat(word(6), F.lit("."), F.pmod(i, F.lit(100)).cast("string"), F.lit("@mail"), F.pmod(i, F.lit(9)).cast("string"), F.lit("."), word(7), F.lit(".com"))
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    path = F.concat(F.lit("/"), word(8), F.lit("/"), word(9), F.lit("/"), word(10), F.pmod(i, F.lit(50)).cast("string"), pick(".html", ".png", ".py", "", "/index"))
    version = F.concat(word(11), F.lit("-"), word(12), F.lit("-"), F.pmod(i, F.lit(9)).cast("string"), F.lit("."), F.pmod(i, F.lit(30)).cast("string"), F.lit("."), F.pmod(i, F.lit(7)).cast("string"))
    named = F.concat(word(13), F.lit("_"), word(14), word(15), F.pmod(i, F.lit(1000)).cast("string"))
    digests = F.concat(word(16), F.lit(" "), pick("commit ", "sha256: ", "md5 = ", "checksum ", "digest: ", "etag: "))
    other = F.when(kind == 0, address).when(kind == 1, uuid).when(kind == 2, path).when(kind == 3, version).when(kind == 4, named).when(kind < 7, F.substring(digest, F.lit(1), size)).otherwise(F.concat(pick("your-", "my-", "xxxx-"), word(17), F.lit("-here-"), F.pmod(i, F.lit(9)).cast("string"), F.lit("00000000")))
    before = F.when(kind == 1, pick(plain, F.concat(plain, F.lit("uuid: ")))).when((kind == 5) | (kind == 6), digests).when(kind == 7, telling).otherwise(plain)
    is_secret = F.pmod(i, F.lit(2)) == 0
    short = F.element_at(F.array(*[F.lit(x) for x in range(8, 17)]), (F.pmod(F.xxhash64(i, F.lit(98)), F.lit(9)) + 1).cast("int"))
    password = F.translate(F.substring(base64, F.lit(3), short), "abcdefgh", "!#$%^*?~")
    letters = F.translate(F.substring(base64, F.lit(1), short + 6), "0123456789+", "qwertyuiopz")
    numbers = F.translate(F.substring(digest, F.lit(1), short + 6), "abcdef", "012345")
    alnum = F.translate(F.substring(base64, 1, 40), "+", "P")
    number = F.pmod(F.xxhash64(i, F.lit(97)), F.lit(9990)).cast("string")
    # what people choose: a word or letters with a number and a sign, and runs of letters
    chosen = pick(
        F.concat(word(24), number, F.lit("a")), F.concat(F.substring(F.lower(letters), F.lit(1), F.lit(6)), F.lit("1!")), F.lower(F.substring(letters, F.lit(1), short)),
        F.concat(F.lower(F.substring(letters, F.lit(2), short)), number), F.concat(F.initcap(word(25)), number, F.lit("!")),
    )
    known = pick(F.concat(F.lit("glpat-"), F.substring(alnum, 1, 20)), F.concat(F.lit("hf_"), F.substring(alnum, 1, 34)), F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(alnum, 1, 24)))
    assigned = F.concat(word(1), F.lit(" "), pick("token", "api_key", "DB_PASSWORD", "password", "client_secret", "pwd", "passwd"), pick(' = "', '="', ": ", "=", " = '", ': "'))
    header = F.concat(F.lit("-----BEGIN "), pick("RSA ", "", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----"))
    form = F.pmod(F.xxhash64(i, F.lit("form")), F.lit(17))
    # words of prose behind a telling name, and settings that are no secrets
    said = F.concat(word(20), pick("er", "ing", "ation", "ed", "ly"), word(21))
    setting = pick(said, F.concat(word(20), F.lit(" "), word(21), F.lit(" "), word(22)), F.concat(word(20), pick("_", "-"), word(21)), F.lit("disabled"), F.lit("required"), F.lit("<your-password>"), F.lit("${PASSWORD}"), F.lit("os.environ"), F.concat(word(20), F.lit("."), word(21), F.lit("()")))
    secret = F.when(form < 6, secret).when(form < 8, password).when(form == 8, letters).when(form == 9, numbers).when(form == 10, known).when(form == 11, pick(password, letters, F.substring(digest, 1, 12))).when(form >= 14, chosen).when(form == 12, F.when(F.pmod(F.shiftright(i, 1), F.lit(2)) == 0, header).otherwise(F.concat(header, F.lit("\n"), base64, F.lit("\n"), F.regexp_replace(header, "BEGIN", "END")))).otherwise(pick(F.substring(digest, 1, 32), F.substring(alnum, 1, 24)))
    telling_ = F.when(form < 6, telling).when((form < 10) | (form >= 14), assigned).when((form == 10) | (form == 12), plain).when(form == 11, F.concat(plain, pick("https", "postgres", "redis"), F.lit("://"), word(23), F.lit(":"))).otherwise(F.concat(plain, pick("https://host.org/a?token=", "/v1?page=2&api_key=", "Authorization: Bearer ", "export API_TOKEN=")))
    worded = (form >= 6) & (form < 9)
    candidate, before = F.when(is_secret, secret).when(worded, setting).otherwise(other), F.when(is_secret, telling_).when(worded, assigned).otherwise(before)
    closing = F.when(is_secret & (form == 11), F.lit("@db.host/")).when(F.endswith(before, F.lit('"')), F.lit('" ')).when(F.endswith(before, F.lit("'")), F.lit("' ")).otherwise(F.lit(" "))
    # written, since expressions over the rule's columns are too long to compile
    texts = written(rows.select("id", F.concat(before, candidate, closing, word(18)).alias("text"), candidate.alias("planted"), is_secret.alias("of_secret")), "labelled-texts")
    label = F.col("of_secret") & (F.contains("planted", F.col("candidate")) | F.contains("candidate", F.col("planted")))
    return candidates(texts, "id").join(texts.drop("text"), "id").select("candidate", "before", "after", label.cast("double").alias("label"))


def train(findings: DataFrame) -> RandomForestClassificationModel:
    rows = written(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings)).select("features", "label"), "labelled-features")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, key: str = "doc_id") -> DataFrame:
    """(key, start, candidate, before, after, score, is_secret), a row for each candidate of each row of docs(key, text, ...).

    A null or empty text has no candidates; a text of any length is searched whole. Repeated rows give
    their candidates as often; extra columns are ignored; an empty table gives an empty result.
    """
    found = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, key)))
    score = vector_to_array("probability")[1]
    return model.transform(found).select(key, "start", "candidate", "before", "after", score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """docs with each secret of `text` replaced by REDACTED and n_chars, where it is a column, counted anew. Rows and other columns, whatever their names, stay as they are; rows with a null doc_id and repeated rows are redacted like any others."""
    digest, secrets = free_name(docs.columns, "_digest"), free_name(docs.columns, "_secrets")
    keyed = docs.withColumn(digest, F.md5(F.col("text").cast("binary")))
    found = scan(keyed.select(F.col(digest).alias("digest"), "text"), model, threshold, "digest").where("is_secret")
    # a row for each text with secrets: their places, fewer than the text has characters
    place = F.struct("start", F.length("candidate").alias("length"))
    of_text = written(found.groupBy(F.col("digest").alias(digest)).agg(F.array_sort(F.collect_set(place)).alias(secrets)), "secrets")
    size = of_text.agg(F.sum(50 + 16 * F.size(secrets))).first()[0] or 0
    joined = keyed.join(F.broadcast(of_text) if size <= BROADCAST else of_text.hint("merge"), digest, "left")

    def end(i: Column) -> Column:
        """Of the secret before number i."""
        return F.coalesce(F.get(secrets, i - 1)["start"] + F.get(secrets, i - 1)["length"], F.lit(0))

    parts = F.transform(secrets, lambda s, i: F.concat(F.substring("text", end(i) + 1, s["start"] - end(i)), F.lit(REDACTED)))
    rest = F.substring("text", end(F.size(secrets)) + 1, F.length("text"))
    text = F.when(F.col(secrets).isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest))
    columns = {"text": text, "n_chars": F.when(F.col(secrets).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {"text": text}
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(labelled_findings(spark)))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")
