"""Secrets in texts: patterns propose candidates, a random forest removes false positives. DataFrame functions and MLlib only."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.pii import _BLOCK, _ends, _item, _with_matches, Kind
from octolith.llm.spark import cut, partitions

_NAMED = r"(?i:secret|token|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key|[_-]key|\bkey)[A-Za-z0-9_]{0,10}[\"']?\s{0,2}(?:=>|[:=])\s{0,2}"
#: Proposed are: tokens with dots of known issuers; what is assigned to the name of a secret, in quotes or bare, of any
#: alphabet from four characters on; what follows a bearer; the password of an address; and runs of at least 16 characters
#: of keys and digests, taken whole. The short look back in front keeps the long one from being tried at every character.
CANDIDATE = Kind(
    "secret",
    # whatever is proposed begins behind a sign that no run has, so most characters cost one look back
    r"(?<![A-Za-z0-9+/_\-])(?:"
    + "|".join((
        r"(?<!\.)(?:SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+)",
        rf"(?<=[\"'`])(?<=[:=>]\s{{0,2}}[\"'`])(?<={_NAMED}[\"'`])[^\s\"'`]{{4,}}+(?=[\"'`])",
        rf"(?<=[:=>\s])(?<=[:=>]\s{{0,2}})(?<={_NAMED})[^\s\"'`,;&<>(){{}}\[\]]{{3,}}[^\s\"'`,;&<>(){{}}\[\].?:]",
        r"(?<=[rR]\s)(?<=\b[bB]earer\s)[A-Za-z0-9+/._~=-]{7,}[A-Za-z0-9+/=_~-]",
        r"(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s/@]++(?=@)",
        r"[A-Za-z0-9+/_\-]{16,}+={0,2}",
    ))
    + ")",
    "", "", 0.0, 0.0,
)
#: Shapes that issuers document, as fixed values.
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{35}|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)$"
#: Words and syllables that names and prose are made of; what they cover of a candidate is no key.
DICTIONARY = "(?:" + "|".join("the and for with this that from have not are was all can has one out who its get set new user name test data file path code list type item value index page image icon link main menu view form text html http www com org net class style color font size width height left right top bottom button click event handler error message request response server client config option param query result table column field string number array object function method return import export default module package version update delete create insert select where order group join table start stop begin end time date year month day hour ing tion ent ion ter con pro per ver est ment able ness less ful ous ive".split()) + ")"
NEAR = r"(?i)(?:secret|token|passw(?:or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?secret|\bkey)\W{0,6}$"
NEAR_WIDE = r"(?i)secret|token|passw|pwd|key|auth|bearer|credential"
HARMLESS = r"(?i)commit|sha-?(?:1|256|512)?\b|md5|checksum|digest|uuid|guid|revision|integrity|etag|build|image|example|sample|placeholder|dummy|https?:|/"
HOLDER = r"(?i)^[<$%{*\[]|change-?_?me|your|placeholder|redacted|hidden|^(?:none|null|true|false|yes|no|required|optional|string|undefined)$|\*{3}"
PATH_TEST = r"(?i)test|example|sample|doc|fixture|mock|spec|vendor|lock"

FEATURES = ["n", "moves", "kinds", "digit_share", "upper_share", "lower_share", "other_share", "different", "hex_only", "uuid_like", "covered", "longest_word", "near", "near_wide", "harmless", "assigned", "quoted", "path_test", "known_shape", "repeats", "in_address", "plain_word", "holder", "numeric"]


def _share(m: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(m, pattern, "")) / F.length(m)


_SIGNS = [chr(c) for c in range(33, 127)]


def features(m: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Length, character transitions, dictionary coverage, neighbouring words and path of a candidate, as numbers."""
    n = F.length(m)
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "+/_-=", "-----")
    folded = F.regexp_replace(classes, r"(.)\1+", "$1")
    low = F.lower(m)
    flag = lambda c: c.cast("double")
    out = {
        "n": F.least(n, F.lit(200)).cast("double"),
        "moves": (F.length(folded) - 1) / n,
        "kinds": F.size(F.array_distinct(F.split(classes, ""))).cast("double"),
        "digit_share": _share(m, "[0-9]"),
        "upper_share": _share(m, "[A-Z]"),
        "lower_share": _share(m, "[a-z]"),
        "other_share": _share(m, "[^A-Za-z0-9]"),
        "different": F.size(F.filter(F.array(*[F.lit(c) for c in _SIGNS]), lambda c: F.contains(m, c))) / F.least(n, F.lit(40)),
        "hex_only": flag(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "uuid_like": flag(low.rlike("^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")),
        "covered": _share(low, DICTIONARY),
        "longest_word": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w))), F.lit(0)) / n,
        "near": flag(F.regexp_replace(before, r"[\s\"'`:=>]+$", " ").rlike(NEAR)),
        "near_wide": flag(before.rlike(NEAR_WIDE)),
        "harmless": flag(before.rlike(HARMLESS)),
        "assigned": flag(before.rlike(r"[:=]>?\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "path_test": flag(F.coalesce(path, F.lit("")).rlike(PATH_TEST)),
        "known_shape": flag(m.rlike(KNOWN)),
        "in_address": flag(before.rlike(r"://[^\s:/@]{1,64}:$")),
        "plain_word": flag(m.rlike(r"^[A-Za-z]?[a-z]+$|^[A-Z]+$")),
        "holder": flag(m.rlike(HOLDER)),
        "numeric": flag(m.rlike(r"^[0-9.,:%-]+$")),
        "repeats": flag(m.rlike(r"(.)\1{5,}|(?i)x{4,}|0123456|abcdef(?:gh|012)|example")),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def labelled_findings(spark: SparkSession, n: int = 8000) -> DataFrame:
    """``m, before, after, path, label``: findings with known labels, made from hashes of row numbers.

    Keys of several alphabets and passwords after names of secrets or in addresses are true
    findings; digests of commits and files, UUIDs, identifiers, paths, addresses, words, numbers and
    placeholders are false ones. Real labelled findings of the same columns can be used instead.
    """
    h = lambda k: F.md5(F.concat_ws(":", F.lit(k), "id"))
    pick = lambda k, *options: F.get(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(options))).cast("int"))
    base = F.translate(F.base64(F.unhex(F.concat(h("a"), h("b")))), "=", "")
    cut_ = lambda c, k, low, high: F.substring(c, F.lit(1), (F.lit(low) + F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(high - low + 1))).cast("int"))
    hex40 = F.left(F.concat(h("c"), h("d")), F.lit(40))
    word = lambda k: pick(k, "user", "config", "handler", "request", "element", "response", "manager", "factory", "service", "iterator", "description", "container", "navigation", "information", "transaction", "the", "nation", "ering", "ention", "thenever")
    name = pick("n", "token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "key", "TOKEN", "SECRET_KEY", "passwd", "bearer")
    text = pick("t", "the rest of it ", "and then on ", "some more words. ", "thand inges ", "see below: ", "")
    key = F.concat(text, name, pick("o", " = \"", "=\"", ": \"", "=", ": ", " = '", "\": \"", " "))
    digest = F.concat(text, pick("w", "commit ", "sha256: ", "sha1=", "md5 ", "revision ", "checksum ", "uuid ", "build ", "etag: \"", "integrity sha512-", "id ", "in ", "https://example.org/x/", "image/", "a "))
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("v"), 1, 12))
    join = pick("j", "_", "-", "", "/")
    ident = F.concat(word("1"), join, word("2"), join, word("3"))
    camel = F.concat(word("1"), F.initcap(word("2")), F.initcap(word("3")), pick("z", "", "2", "Id"))
    number = F.translate(F.concat(h("x")), "abcdef", "012345")
    holder = pick("p", "xxxxxxxxxxxxxxxxxxxxxxxx", "0000000000000000000000000000", "your-secret-key-goes-here", "EXAMPLEKEYEXAMPLEKEY", "abcdefghijklmnopqrstuvwxyz", "----------------------------", "________________________", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "changeme-changeme-changeme", "0123456789abcdef0123456789abcdef")
    sign, digits = pick("sy", "!", "@", "#", "$", "%", "&", "*", "?", "-", "_", "."), F.substring(number, 4, 3)
    plain = F.translate(base, "+/", "xY")
    mixed = F.concat(F.left(plain, F.lit(4)), sign, F.substring(plain, 7, 5))
    spoken = F.when(F.col("id") % 3 == 0, F.concat(F.initcap(word("1")), digits, sign)).when(F.col("id") % 3 == 1, F.concat(word("1"), sign, digits)).otherwise(F.concat(F.initcap(word("1")), F.left(digits, F.lit(2)), word("2")))
    address = F.concat(text, pick("ad", "postgres://", "mysql://", "https://", "amqp://", "redis://"), word("u"), F.lit(":"))
    dotted = F.concat(F.lit("eyJ"), F.left(plain, F.lit(17)), F.lit(".eyJ"), F.substring(plain, 9, 20), F.lit("."), F.left(F.translate(F.base64(F.unhex(F.concat(h("k"), h("l")))), "+/=", "aZ"), F.lit(40)))
    word_value = pick("wv", "required", "string", "none", "true", "false", "value", "default", "optional", "changed", "forgotten", "expired", "invalid", "missing", "important", "enabled", "settings", "username", "Primary", "Enter")
    held = pick("hv", "<password>", "${PASSWORD}", "{{token}}", "********", "changeme", "your_password", "your-token-here", "xxxxxxxx", "example", "%SECRET%", "[hidden]", "password", "secret", "test1234")
    where_ = pick("wh", "https://example.org/tokens", "/etc/secrets/key.pem", "config/auth.yml", "os.environ", "settings.SECRET_KEY", "getpass.getpass", "request.headers.token", "http://localhost/login", "docs/keys.md")
    kinds = [
        (mixed, key, 1), (spoken, key, 1), (cut_(plain, "s", 8, 15), key, 1), (mixed, address, 1), (spoken, address, 1), (dotted, text, 1), (F.concat(F.lit("SG."), F.left(plain, F.lit(22)), F.lit("."), F.left(hex40, F.lit(40)), F.lit("aZ9")), key, 1),
        (word_value, key, 0), (word_value, key, 0), (held, key, 0), (where_, key, 0), (word("1"), key, 0), (F.left(number, F.lit(5)), key, 0), (F.concat(digits, F.lit("."), F.left(digits, F.lit(2))), key, 0), (held, address, 0),
        (hex40, key, 1), (F.upper(hex40), key, 1), (cut_(base, "q", 20, 40), key, 1), (h("e"), key, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.left(h("f"), F.lit(16)))), F.concat(text, pick("w", "key ", "", "aws ")), 1), (F.concat(F.lit("ghp_"), cut_(F.translate(base, "+/", "aZ"), "g", 36, 36)), text, 1),
        (hex40, digest, 0), (cut_(base, "r", 20, 43), digest, 0), (uuid, F.concat(text, pick("w", "id ", "uuid=", "token ", "")), 0), (ident, F.concat(text, pick("y", "", "", "token = ")), 0), (camel, text, 0), (F.left(number, F.lit(18)), text, 0), (holder, F.concat(text, pick("w", "key = \"", "", "token: ")), 0), (F.concat_ws("", word("1"), word("2"), word("3"), word("4")), text, 0),
    ]
    out = None
    for k, (m, before, label) in enumerate(kinds):
        rows = spark.range(k * 1_000_000, k * 1_000_000 + max(1, n // len(kinds))).select(m.alias("m"), before.alias("before"), pick("e", "\"", "\" and", "' ", " then ", "\n", ". ", "").alias("after"), pick("path", "src/app", "src/app", "conf/prod", "tests/data", "docs/example", "web").alias("path"), F.lit(float(label)).alias("label"))
        rows = rows.where(F.length("m") >= 4)
        out = rows if out is None else out.unionByName(rows)
    return out


def train(findings: DataFrame, *, trees: int = 40, depth: int = 8, seed: int = 5) -> PipelineModel:
    """A random forest over ``findings(m, before, after, path, label)``; label 1 is a secret. Null texts count as empty."""
    f = findings.select(*[v.alias(k) for k, v in features(*[F.coalesce(F.col(c), F.lit("")) for c in ("m", "before", "after", "path")]).items()], F.col("label").cast("double").alias("label"))
    f = cut(f.coalesce(partitions(f.sparkSession)))  # the forest reads the rows several times
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(f)


def candidates(docs: DataFrame, *, reach: int = 40) -> DataFrame:
    """``doc_id, start, end, m, before, after, path``: each candidate of a text with its surroundings; offsets in code points."""
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), path.alias("path"))
    df = _with_matches(df, "text", [CANDIDATE], {"secret": ("m", "g")}).where(F.size("m") > 0).select("doc_id", "path", "m", "g")
    df = df.withColumn("i", F.transform("m", _item(F.col("g"), reach))).select("doc_id", "path", "i")
    df = df.withColumn("w", F.transform("i", lambda x: x["gap"] + x["n"]))
    df = df.withColumn("s", _ends(F.col("w")))

    def placed(x, i):
        inside = F.aggregate(F.slice(F.col("s.w"), i - i % _BLOCK + 1, i % _BLOCK + 1), F.lit(0), lambda a, y: a + y)
        end = F.get(F.col("s.base"), F.floor(i / _BLOCK).cast("int")) + inside
        return F.struct((end - x["n"]).cast("long").alias("start"), end.cast("long").alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))

    return df.select("doc_id", "path", F.explode(F.transform("i", placed)).alias("x")).select("doc_id", "x.*", "path")


def find(docs: DataFrame, model: PipelineModel, *, least: float = 0.5) -> DataFrame:
    """``doc_id, start, end, secret_sha256, score, is_secret``: one row for each candidate of ``docs(doc_id, text)``; the ``source`` column, if any, is the path.

    A null or empty text has no candidates, a repeated row gives its candidates again, an empty
    table gives no rows, other columns are ignored. There is no shuffle; the secret itself is only
    returned as a digest.
    """
    f = candidates(docs)
    f = f.select("doc_id", "start", "end", F.sha2("m", 256).alias("secret_sha256"), *[v.alias(k) for k, v in features(F.col("m"), F.col("before"), F.col("after"), F.col("path")).items()])
    scored = model.transform(f).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.select("doc_id", "start", "end", "secret_sha256", "score", (F.col("score") >= least).cast("int").alias("is_secret"))
