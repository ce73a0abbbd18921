"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

The forest (pyspark.ml, in the JVM) sees a candidate's length, how likely its character
transitions are in ordinary text, its coverage by a dictionary, the path of its file and
the neighbouring words. It is trained from labelled findings: any table of them, or ones
made by rule and set into excerpts of the documents at hand.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import documents, stash
from tessella.llm.winnowing import let

#: Words for credentials in English, German, French and Spanish.
_WORD = r"(?i:password|passwd|passphrase|pwd|passwort|kennwort|mot[ _-]?de[ _-]?passe|contrase[ñÑn]a|(?<![A-Za-z])clave|secret|token|api[_-]?key|access[_-]?key|credential|(?<![A-Za-z])(?:auth|pass)(?![A-Za-z]))"
#: As lines of a .netrc have it, between blanks.
_LOGIN = r"(?i:(?<![A-Za-z])login\s++[^\s:=]++\s++passw(?:or)?d\s++(?![:=]))"
#: A credential's word, the last of its kind in a name, the rest of the name and what gives it a value.
_NAME = r"(?:" + _LOGIN + "|" + _WORD + r"(?:(?!" + _WORD + r")[A-Za-z0-9_.-])*+(?:\\?[\"'`])?\s*+(?:=>|[=:]{1,2})\s*+)"
#: Up to the closing quote, whatever stands between; `\"` opens and closes inside a quoted text.
_QUOTED = r"\"(?:[^\"\\\r\n]++|\\.)++(?=\")|'(?:[^'\\\r\n]++|\\.)++(?=')|`(?:[^`\\\r\n]++|\\.)++(?=`)|\\\"[^\"\\\r\n]++(?=\\\")|\\'[^'\\\r\n]++(?=\\')"
_BARE = r"[\"'`]{0,3}+(?!\\[\"'`])[^\s\"'`,;]++"
_HEAD = r"-----BEGIN [A-Z ]*?PRIVATE KEY(?: BLOCK)?-----"
#: From BEGIN to END; of a key that is cut off, the lines that look like its body.
_BLOCK = _HEAD + r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*?PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]++(?:\s|-{1,5}(?:END[A-Z ]*+)?)*+\z)?+)"
_URL_NAME = r"://[^\s/?#:@\"'`<>]*+:"
_URL = _URL_NAME + r"[^\s/?#\"'`<>]+(?=@)"
_OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
_NO_BLOCK = r"(?![\"'`]{0,3}-----BEGIN )"
#: What may be a secret: a value given to a credential's name, the password of a URL, a whole private key, a long opaque run with a digit.
CANDIDATE = f"{_NAME}{_NO_BLOCK}(?:{_QUOTED}|{_BARE})|{_BLOCK}|{_URL}|{_OPAQUE}"
#: The same, values only up to white space: what a quoted value of several words may hold.
_INNER = f"{_NAME}{_NO_BLOCK}{_BARE}|{_BLOCK}|{_URL}|{_OPAQUE}"
#: Characters of the neighbourhood that are looked at on each side.
NEAR = 48

#: Characters on each side in which words of credentials and of checksums are looked for.
BESIDE = 24
#: Words of the dictionary that the labelled findings' neighbourhoods give, the most frequent ones.
WORDS = 2000
#: Excerpts of documents, of so many characters, that labelled findings are set into.
EXCERPTS, EXCERPT = 1000, 200

#: Prefixes by which issued keys are known, common stand-in words, words about credentials, checksums and measures, parts of paths: fixed values.
KNOWN = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xox[abp]-|AIza|eyJ|-----BEGIN)"
STAND_INS = (
    "example sample placeholder changeme change dummy default password passwd secret token test your here none null true false user admin "
    "value string file path version section page image data index home html http https www com the and for with from key name required optional"
).split()
#: Common English words, part of every dictionary: fixed values.
COMMON = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who its did yes she may use "
    "that with have this will your from they know want been good much some time very when come here just like long make many more only over such take "
    "than them well were what about after again other their there these things think which would could should people between before through where while "
    "because under never every found still place small large great right world house water number first second third last next same each most both own "
    "work life hand part year week word line side head home form show move read open close start stop find give tell ask team name user field letter group"
).split()
CREDENTIAL_WORDS = r"(?i)\b(?:password|passwd|passphrase|pwd|passwort|kennwort|mot de passe|contraseña|clave|pass\b|secret|token|api.?key|access.?key|auth|authorization|bearer|credential|login|private)"
HASH_WORDS = r"(?i)\b(?:commit|sha-?\d*|md5|checksum|digest|hash|revision|etag|integrity|uuid|guid|build|isbn|serial|order|invoice|card|phone|tel|base64)\b"
MEASURES = r"(?i)tokens|tokeni[sz]|count|max|min|num|len|size|type|limit|expir|ttl|path|file|url|field|header|policy|hint|reset"
PLAIN_PATH = r"(?i)(?:^|[/_.-])(?:tests?|examples?|fixtures?|mocks?|samples?|docs?)(?:[/_.-]|$)"

FEATURES = (
    "length", "assigned", "in_url", "known_prefix", "digits", "uppers", "marks", "hexadecimal", "numeric", "uuid", "runs", "transitions",
    "coverage", "segment", "distinct", "stand_in", "code", "near_credential", "near_hash", "measure", "plain_path",
)


@dataclass(frozen=True)
class Model:
    forest: RandomForestClassificationModel
    transitions: tuple[float, ...]  # log-probability of a letter after another, row by row; the 27th stands for all else
    dictionary: tuple[str, ...]


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate: the other columns of `df`, and __at, a struct of start and length in code points, candidate, left, right.

    A text without candidates, empty or null gives no row. What stands between the
    candidates gives their places and their neighbourhood. A quoted value of several words
    is a candidate, and what it holds are candidates, too; their places overlap.
    """
    rows = _placed(df.withColumn("__whole", F.col(text)), CANDIDATE, "__each").where(F.size("__each") > 0)
    others = [c for c in df.columns if c != text]
    rows = rows.select(*others, F.explode("__each").alias("__outer")).withColumn("__name", F.regexp_extract("__outer.candidate", f"^{_NAME}", 0))
    several = (F.length("__name") > 0) & F.expr("substring(__outer.candidate, length(__name) + 1)").rlike(r"\s")
    rows = _placed(rows.withColumn("__whole", F.when(several, F.col("__outer.candidate"))), _INNER, "__inner")
    shifted = F.transform(
        "__inner",
        lambda x: F.struct(
            (F.col("__outer.start") + x["start"]).alias("start"),
            x["length"].alias("length"),
            x["candidate"].alias("candidate"),
            F.when(x["start"] > 0, x["left"]).otherwise(F.col("__outer.left")).alias("left"),
            x["right"].alias("right"),
        ),
    )
    every = F.concat(F.array("__outer"), F.coalesce(shifted, F.array().cast(rows.schema["__inner"].dataType)))
    return rows.select(*others, F.explode(every).alias("__at"))


def _placed(rows: DataFrame, pattern: str, into: str) -> DataFrame:
    """What the pattern finds in __whole, as an array of start, length, candidate, left, right; null for a null text.

    The matches, what stands between them and the sums of their lengths are each bound
    once: work grows with the text, however many matches it has.
    """
    whole = F.col("__whole")
    found = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))

    def each(own: Column) -> Column:
        between, matches = own["between"], own["found"]
        advance = F.zip_with(F.transform(between, lambda x: F.length(x)), F.transform(matches, lambda x: F.length(x)), lambda a, b: a + F.coalesce(b, F.lit(0)))
        place = lambda x, i, before: F.struct(
            (F.get(before, i) + F.length(F.get(between, i))).cast("long").alias("start"),
            F.length(x).cast("long").alias("length"),
            x.alias("candidate"),
            F.right(F.get(between, i), F.lit(NEAR)).alias("left"),
            F.left(F.get(between, i + 1), F.lit(NEAR)).alias("right"),
        )
        return let(folded(advance, F.lit(0), lambda a, b: a + b), lambda before: F.transform(matches, lambda x, i: place(x, i, before)))

    pieces = lambda own: F.struct(own.alias("found"), F.when(F.size(own) > 0, F.split(whole, pattern, -1)).alias("between"))
    placed = let(found, lambda own: F.when(F.size(own) > 0, let(pieces(own), each)))
    empty = F.array().cast("array<struct<start:bigint,length:bigint,candidate:string,left:string,right:string>>")
    return rows.withColumn(into, F.when(whole.isNotNull(), F.coalesce(placed, empty))).drop("__whole")


def folded(values: Column, zero: Column, f: Callable[[Column, Column], Column]) -> Column:
    """For each place, f over all values before it, from `zero` on; f is associative.

    In blocks, whose own results are folded likewise: an array that grows by appending is
    copied at each step, so only short ones do.
    """
    block = 512
    grown = lambda xs: F.aggregate(xs, F.array(zero), lambda acc, x: F.array_append(acc, f(F.element_at(acc, -1), x)))
    blocks = lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / block).cast("int")), lambda j: grown(F.slice(own, j * block + 1, F.lit(block))))
    put = lambda xs, base: F.transform(F.slice(xs, F.lit(1), F.size(xs) - 1), lambda x: f(base, x))
    bases = lambda own: grown(F.transform(own, lambda xs: F.element_at(xs, -1)))
    whole = lambda own: let(blocks(own), lambda parts: let(bases(parts), lambda base: F.flatten(F.transform(parts, lambda xs, j: put(xs, F.get(base, j))))))
    return let(values, lambda own: F.when(F.size(own) > 0, whole(own)).otherwise(F.slice(own, 1, 0)))


def value_of(candidate: Column) -> Column:
    """The value alone, where the candidate names what it is given to."""
    return F.regexp_replace(candidate, rf"^(?:{_NAME}\\?[\"'`]{{0,3}}|{_URL_NAME})", "")


def _transitions(value: Column, table: tuple[float, ...]) -> Column:
    """The mean log-probability of the value's successive characters as ordinary text; 0 for a single one."""
    lookup = F.split(F.lit(" ".join(f"{x:.6f}" for x in table)), " ").cast("array<double>")
    codes = F.transform(F.split(F.lower(value), ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).otherwise(26))
    pairs = let(codes, lambda own: F.zip_with(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.get(lookup, a * 27 + b)))
    return let(pairs, lambda own: F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x) / F.size(own)).otherwise(0.0))


def with_features(rows: DataFrame, transitions: tuple[float, ...], dictionary: tuple[str, ...]) -> DataFrame:
    """Adds the features of rows with __at (candidate, left, right) and __path; nulls count as empty."""
    full, left, right, path = (F.coalesce(F.col(c), F.lit("")) for c in ("__at.candidate", "__at.left", "__at.right", "__path"))
    rows = rows.withColumn("__value", value_of(full)).withColumn("__name", F.expr("left(__at.candidate, length(__at.candidate) - length(__value))"))
    value, size = F.col("__value"), F.greatest(F.length("__value"), F.lit(1))
    lower, name = F.lower(value), F.col("__name")
    known = F.split(F.lit(" ".join(dictionary)), " ")
    parts = F.filter(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & F.array_contains(known, F.lower(w)))
    flag = lambda c: c.cast("double")
    around = F.concat(F.right(left, F.lit(BESIDE)), F.lit(" "), name)
    made = {
        "length": F.log(F.lit(1) + F.length(value)),
        "assigned": flag((F.length(name) > 0) & ~name.startswith("://")),
        "in_url": flag(name.startswith("://")),
        "known_prefix": flag(value.rlike(KNOWN)),
        "digits": F.regexp_count(value, F.lit("[0-9]")) / size,
        "uppers": F.regexp_count(value, F.lit("[A-Z]")) / size,
        "marks": F.regexp_count(value, F.lit("[!-/:-@\\[-`{-~]")) / size,
        "hexadecimal": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "numeric": flag(value.rlike("^[0-9+/_-]+$")),
        "uuid": flag(value.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "runs": F.regexp_count(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) / size,
        "transitions": _transitions(value, transitions),
        "coverage": F.aggregate(parts, F.lit(0), lambda acc, w: acc + F.length(w)) / size,
        "segment": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.length(w))), F.lit(0)) / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "stand_in": flag(lower.rlike(r"[<>${}*]|\.\.\.|x{5}|(?:^|[^a-z])(?:" + "|".join(STAND_INS) + ")(?:[^a-z]|$)")),
        "code": flag(value.rlike(r"[(\[]|^[A-Za-z_]++(?:\.[A-Za-z_]++)+$|^(?:str|int|bool|None|True|False|null|nil|self|this)\b")),
        "near_credential": flag(around.rlike(CREDENTIAL_WORDS)),
        "near_hash": flag(F.concat(around, F.lit(" "), F.left(right, F.lit(BESIDE // 2))).rlike(HASH_WORDS)),
        "measure": flag(F.concat(F.regexp_extract(left, "[A-Za-z0-9_.-]*$", 0), name).rlike(MEASURES)),
        "plain_path": flag(path.rlike(PLAIN_PATH)),
    }
    rows = rows.withColumns({f"__{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()})
    return VectorAssembler(inputCols=[f"__{k}" for k in FEATURES], outputCol="__features").transform(rows)


def excerpts(docs: DataFrame, text: str = "text", path: str = "source", n: int = EXCERPTS) -> DataFrame:
    """k (from 0), left, right, path: neighbourhoods for labelled findings, each from a place in a text of `docs`.

    The `n` texts with the smallest hashes are taken, the bounded sample that the forest is
    fitted on. Equal texts give equal excerpts; null and empty ones none.
    """
    place = F.pmod(F.xxhash64(text, F.lit(1)), F.length(text)).cast("int")
    some = docs.where(F.length(text) > 0).select(F.xxhash64(text).alias("h"), F.substring(F.col(text), place + 1, F.lit(EXCERPT)).alias("x"), F.col(path).cast("string").alias("path"))
    some = some.orderBy("h", "path").limit(n)
    half = F.floor(F.length("x") / 2).cast("int")
    return some.select((F.row_number().over(W.orderBy("h", "path")) - 1).cast("long").alias("k"), F.left("x", half).alias("left"), F.substring(F.col("x"), half + 1, F.lit(EXCERPT)).alias("right"), "path")


def labelled_findings(spark: SparkSession, around: DataFrame | None = None, n: int = 12_000, first: int = 0) -> DataFrame:
    """`n` findings with labels (candidate, left, right, path, label), made from counters `first`, ...: the same ones every time.

    Half are keys, tokens and passwords as they are issued or set; half are what scanners
    report by mistake: checksums, commit ids, UUIDs, numbers, stand-ins, code, settings that
    are no credentials, names and slugs made of the neighbourhood's own words. All kinds
    stand in the same neighbourhoods and paths: those of `around` (see excerpts), else a few
    fixed ones. So only what a kind itself brings along can tell them apart.
    """
    row = lambda salt: F.xxhash64("id", F.lit(salt))
    upto = lambda salt, k: F.pmod(row(salt), F.lit(k)).cast("int")
    some = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), upto(salt, len(xs)) + 1)
    hexes = F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 512)
    b64 = F.base64(F.unhex(F.concat(hexes, F.sha2(hexes, 512))))
    mixed = F.regexp_replace(b64, "[+/=\r\n]", "")
    raw = F.regexp_replace(b64, "[=\r\n]", "")
    digits = F.regexp_replace(hexes, "[a-f]", "")
    letters = F.regexp_replace(mixed, "[0-9]", "")
    cut = lambda c, salt, *sizes: F.left(c, some(salt, *sizes))
    long = (16, 20, 24, 32, 40, 48, 64, 80)

    fixed = some(1, "in that section of the", "thereafter the", "as shown below", "and with these", "where it was", "de la que", "und das ist")
    rows = spark.range(first, first + n).select("id")
    if around is None:
        rows = rows.select("id", fixed.alias("left"), fixed.alias("right"), some(2, "src0", "config/app.env", "deploy/settings.py", "docs/guide.md", "tests/data.py").alias("path"))
    else:
        kept = stash(around, "excerpts")
        m = max(kept.count(), 1)
        rows = rows.withColumn("k", F.pmod(row(3), F.lit(m))).join(F.broadcast(kept), "k", "left")  # EXCERPTS rows at most
        rows = rows.select("id", F.coalesce("left", fixed).alias("left"), F.coalesce("right", fixed).alias("right"), "path")
    words = F.filter(F.regexp_extract_all(F.concat_ws(" ", "left", "right"), F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: F.length(w) < 12)
    rows = rows.withColumn("w", F.when(F.size(words) > 3, F.slice(words, 1, 4)).otherwise(F.array(*map(F.lit, ("some", "plain", "word", "list")))))
    word = lambda k: F.get("w", F.lit(k))

    name = some(4, "token", "secret", "api_key", "auth_token", "access_key", "SECRET_KEY", "password", "client-secret", "db.password", "credentials", "auth", "pass", "Passwort", "mot de passe", "contraseña", "clave_api")
    lock = some(5, "password", "passwd", "pwd", "DB_PASSWORD", "user.password", "root_pwd", "pass", "Passwort", "Kennwort", "mot de passe", "Contraseña", "clave")
    assign = some(6, ' = "', "=", ": ", ' = "', ": '", " := ", "      = ", '="')
    quoted = some(7, '"password": "', '"api_key": "', "'secret': '", '"token" => "', '\\"access_key\\": \\"')
    sign = some(8, "!", "$", ",", "#", "%", "@", "&", ";", "_", "-")
    human = F.concat(F.initcap(word(0)), some(9, "", "_", "."), F.left(digits, upto(10, 4) + 1), F.when(upto(11, 3) > 0, sign).otherwise(""))
    signs = F.concat(F.left(mixed, F.lit(4)), sign, F.substring(mixed, 5, 5))
    phrase = F.concat(F.substring(mixed, 1, 5), some(12, " ", ", ", "; "), F.substring(mixed, 6, 6))
    scheme, user = some(13, "postgres", "mysql", "https", "amqp", "redis"), some(14, "admin", "root", "app", "", "deploy", "user")
    head = some(15, "RSA ", "EC ", "OPENSSH ", "")
    block = F.concat(F.lit("-----BEGIN "), head, F.lit("PRIVATE KEY-----\n"), F.substring(raw, 1, 64), F.lit("\n"), F.substring(raw, 9, 50), F.lit("\n"), F.substring(mixed, 3, 7), F.lit("==\n-----END "), head, F.lit("PRIVATE KEY-----"))
    issued = F.concat(some(16, "AKIA", "ASIA"), F.upper(F.left(mixed, F.lit(16))))
    prefixed = F.concat(some(17, "sk-", "ghp_", "xoxb-", "AIza", "glpat-", "sk_live_", "eyJhbGciOiJIUzI1NiJ9"), cut(mixed, 18, 20, 24, 36, 48))
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    stand_in = some(19, "changeme", "your_token_here", "xxxxxxxxxxxx", "<your-secret>", "${SECRET_KEY}", "example-password", "********", "%(password)s", "{{ token }}", "REPLACE_ME_WITH_KEY", "dummy-secret-1", "null", "none")
    code = F.concat(some(20, "get_", "load_", "self.", "os.environ.", "config.", "request.", "new ", "str", "tokenizer."), F.lower(word(1)), some(21, "()", "(x)", '["', ".value", "_name", "[0]", ","))
    plain = some(22, "the", "that", "is", "true", "false", "string", "required", "value", "optional", "none,", "string,", "user", "enabled", "here)", "bearer", "basic")
    prose = F.concat_ws(" ", some(23, "the value of the", "enter your", "this is the", "must not be the", "a string for the"), "w")
    setting = F.concat(some(24, "max_tokens", "tokens", "token_count", "password_min_length", "secret_path", "token_type", "api_key_header", "password_file", "credential-limit", "token_expires", "pwd_policy"), some(6, ' = "', "=", ": ", ' = "', ": '", " := ", "      = ", '="'))
    measured = some(25, "4096", "12", "3600", "/etc/app/secret.txt", "Bearer", "X-Api-Key", "strict", "64", "128000", "30d", "sha256")
    slug = F.concat_ws("-", F.lower(word(0)), F.lower(word(1)), F.lower(word(2)), F.lower(word(3)), F.left(digits, upto(27, 4) + 1))
    slug = F.replace(slug, F.lit("-"), some(26, "-", "_", "/"))
    camel = F.concat(F.lower(word(0)), F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)), F.left(digits, F.lit(1)), some(28, "Handler", "Impl", "Test", ""))
    stamp = F.concat(some(29, "IMG_", "backup-", "log_", "release-", "v"), F.lit("20"), F.left(digits, F.lit(6)), some(30, "_", "T", "-"), F.substring(digits, 7, 6), F.when(upto(31, 2) == 0, F.concat(F.lit("_"), word(0))).otherwise("_00001"))
    common = lambda salt: some(salt, *COMMON[::3])
    dated = F.concat(some(59, "org/", "com/", "blog/", ""), F.lit("20"), F.left(digits, F.lit(2)), F.lit("/0"), F.left(digits, F.lit(1)), F.lit("/"), F.concat_ws("-", common(60), F.lower(word(0)), common(61), F.lower(word(1)), common(62)), F.when(upto(63, 2) == 0, F.concat(F.lit("-"), F.left(digits, F.lit(5)))).otherwise(""))
    file = F.concat(some(64, "src/main/", "lib/", "usr/share/", "app/"), F.concat_ws("/", F.lower(word(2)), common(65), F.lower(word(3))), F.lit("/"), F.initcap(common(66)), F.initcap(word(0)), some(67, "Handler", "Factory", "Test", "Impl", "_v"), F.left(digits, F.lit(1)), some(68, "", "Test", "Spec"))
    checks = some(32, "sha256", "checksum", "digest", "integrity", "md5", "sha512-", "etag", "hash:")
    revision = some(33, "commit", "at revision", "merged as commit", "commit id", "revision", "build")
    holder = some(34, "authorization: bearer", "the api key is", "login with", "its secret:", "use token", "private key")

    beside = F.lit("")
    kinds = [  # label, candidate, what stands before it
        (1, F.concat(name, assign, cut(hexes, 40, *long)), beside),
        (1, F.concat(name, assign, cut(mixed, 41, 12, *long)), beside),
        (1, F.concat(name, assign, cut(raw, 42, *long)), beside),
        (1, F.concat(quoted, signs), beside),
        (1, F.concat(quoted, F.left(letters, F.lit(24))), beside),
        (1, F.concat(quoted, phrase), beside),
        (1, F.concat(lock, assign, human), beside),
        (1, F.concat(lock, assign, F.left(mixed, F.lit(3)), sign, F.substring(mixed, 4, 1)), beside),
        (1, F.concat(lock, assign, cut(mixed, 43, 8, 10, 12, 18)), beside),
        (1, F.concat(lock, assign, cut(hexes, 44, 12, 18, 24)), beside),
        (1, F.concat(F.lit("://"), user, F.lit(":"), cut(mixed, 45, 8, 10, 16, 24)), scheme),
        (1, F.concat(F.lit("://"), user, F.lit(":"), F.initcap(word(0)), F.left(digits, F.lit(3)), some(46, "!", "$", ",", "%", "&", ";", "_", "-")), scheme),
        (1, F.concat(F.lit("login "), user, F.lit(" password "), F.when(upto(76, 2) == 0, F.lower(human)).otherwise(human)), some(70, "machine mail.example.com", "default", "machine db1", "host")),
        (1, F.concat(F.lit("login "), F.lower(word(2)), F.lit(" password "), cut(mixed, 71, 8, 10, 16, 24)), some(72, "machine", "default", "account")),
        (1, block, beside),
        (1, issued, beside),
        (1, prefixed, beside),
        (1, cut(mixed, 47, *long), holder),
        (0, F.concat(name, assign, stand_in), beside),
        (0, F.concat(quoted, stand_in), beside),
        (0, F.concat(name, some(48, " = ", "=", ": "), code), beside),
        (0, F.concat(name, assign, plain), beside),
        (0, F.concat(quoted, prose), beside),
        (0, F.concat(name, some(49, ' = "', '="', ': "'), prose), beside),
        (0, F.concat(name, some(50, ": ", " = ", "="), F.lower(word(0))), beside),
        (0, F.concat(F.lit("login "), some(73, "and", "with", "your", "or", "the", "page"), F.lit(" password "), plain), beside),
        (0, F.concat(some(74, "auth", "pass", "clave", "Passwort", "mot de passe", "contraseña"), some(75, ": ", " = ", ":"), F.lower(word(1))), beside),
        (0, F.concat(setting, measured), beside),
        (0, F.concat(F.lit("://"), some(51, "user", "username", "example", "admin", ""), F.lit(":"), some(52, "password", "pass", "changeme", "<password>", "${PASSWORD}", "****", "secret", "8080")), scheme),
        (0, F.left(hexes, some(53, 40, 40, 32, 64)), revision),
        (0, F.left(hexes, some(54, 32, 40, 64, 64)), checks),
        (0, cut(raw, 55, 44, 64, 88), checks),
        (0, uuid, beside),
        (0, F.concat(some(56, "4", "5", "+49-", "978-", ""), F.left(digits, some(57, 15, 16, 19, 24))), beside),
        (0, slug, beside),
        (0, camel, beside),
        (0, stamp, beside),
        (0, dated, some(69, "https://example.com/", "see", "../")),
        (0, file, beside),
        (0, F.concat(F.lit("iVBORw0KGgo"), cut(raw, 58, 40, 64, 100)), F.lit("data:image/png;base64")),
    ]
    kind = F.pmod("id", F.lit(len(kinds))).cast("int")
    pick = F.element_at(F.array(*[F.struct(F.lit(label).cast("double").alias("label"), c.alias("candidate"), before.alias("before")) for label, c, before in kinds]), kind + 1)
    rows = rows.select("left", "right", "path", pick.alias("x"))
    gap = F.when(F.col("x.candidate").startswith("://"), "").otherwise(" ")
    return rows.select("x.candidate", F.concat("left", F.lit(" "), "x.before", gap).alias("left"), F.concat(F.lit(" "), "right").alias("right"), "path", "x.label")


def _language(labelled: DataFrame) -> tuple[tuple[float, ...], tuple[str, ...]]:
    """Letter transitions and the most frequent words of the findings' neighbourhoods, a bounded sample of ordinary text."""
    near = labelled.select(F.lower(F.concat_ws(" ", "left", "right")).alias("t")).distinct()
    chars = near.select(F.transform(F.split("t", ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).otherwise(26)).alias("c")).where(F.size("c") > 1)
    pairs = chars.select(F.explode(F.zip_with(F.expr("slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c) - 1)"), lambda a, b: a * 27 + b)).alias("p"))
    seen = {r["p"]: r["count"] for r in pairs.groupBy("p").count().collect()}  # 729 at most
    table = []
    for a in range(27):
        own = [seen.get(a * 27 + b, 0) + 1 for b in range(27)]
        table.extend(math.log(x / sum(own)) for x in own)
    words = near.select(F.explode(F.regexp_extract_all("t", F.lit("[a-z]{3,}"), F.lit(0))).alias("w")).groupBy("w").count().where("count > 2")
    found = [r["w"] for r in words.orderBy(F.desc("count"), "w").limit(WORDS).collect()]
    return tuple(table), tuple(dict.fromkeys([*STAND_INS, *COMMON, *found]))


def train(labelled: DataFrame, trees: int = 40, depth: int = 10, seed: int = 8) -> Model:
    """A forest over labelled findings (candidate, left, right, path, label 0.0 or 1.0), any table of them.

    Letter transitions and the dictionary come from the findings' neighbourhoods.
    """
    kept = stash(labelled.select("candidate", "left", "right", "path", "label"), "labelled-findings")
    transitions, dictionary = _language(kept)
    rows = kept.select(F.struct("candidate", "left", "right").alias("__at"), F.col("path").alias("__path"), "label")
    rows = stash(with_features(rows, transitions, dictionary).select("__features", "label"), "labelled")
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    forest = forest.setPredictionCol("__prediction").setProbabilityCol("__probability").setRawPredictionCol("__raw")
    return Model(forest.fit(rows), transitions, dictionary)


def scan(df: DataFrame, model: Model, text: str = "text", path: str = "source", least: float = 0.5) -> DataFrame:
    """One row per candidate of every whole text: other columns of `df`, start, length, value, rule, score, is_secret.

    The place is that of the value, without the name that it is given to. Nothing is
    shuffled; a null path counts as empty; null and empty texts give no rows, equal texts
    equal ones. Columns of `df` with the names of the six results are replaced, all others stay.
    """
    df = df.drop(*({"start", "length", "value", "rule", "score", "is_secret"} - {text, path}))
    rows = candidates(df.withColumn("__path", F.col(path).cast("string")), text)
    scored = model.forest.transform(with_features(rows, model.transitions, model.dictionary))
    rule = F.when(F.col("__in_url") == 1, "password of a URL").when(F.col("__assigned") == 1, "assigned value").when(F.col("__known_prefix") == 1, "known prefix").otherwise("opaque run")
    score = vector_to_array("__probability")[1]
    start, length = F.col("__at.start") + F.length("__name"), F.length("__value").cast("long")
    others = [c for c in df.columns if c != text]
    return scored.select(*others, start.alias("start"), length.alias("length"), F.col("__value").alias("value"), rule.alias("rule"), score.alias("score"), (score >= least).alias("is_secret"))


def redact(df: DataFrame, findings: DataFrame, keys: list[str], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`df` with the secrets among `findings` (keys, start, length) replaced by a mark, overlapping ones by one; other rows stay as they are. Null keys meet null keys."""
    spans = findings.where("is_secret").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("__spans"))
    spans = spans.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    rows = df.join(spans, same, "left").drop(*[f"__of_{k}" for k in keys])
    block = 1024  # texts are cut into blocks, so that a piece isn't looked for from the start on

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / block)
        some = F.slice(blocks, (first + 1).cast("int"), (F.floor(end / block) - first + 1).cast("int"))
        return F.substring(F.array_join(some, ""), (start - first * block + 1).cast("int"), (end - start).cast("int"))

    def marked(own: Column) -> Column:
        blocks, spans, ends = own["blocks"], own["spans"], own["ends"]
        piece = lambda x, i: F.when(x["start"] < F.get(ends, i), "").otherwise(F.concat(cut(blocks, F.get(ends, i), x["start"]), F.lit(mark)))
        last = F.greatest(F.element_at(ends, -1), F.element_at(spans, -1)["start"] + F.element_at(spans, -1)["length"])
        return F.concat(F.array_join(F.transform(spans, piece), ""), let(last, lambda at: cut(blocks, at, F.length(text).cast("long"))))

    # where all spans before each have ended
    ends = folded(F.transform("__spans", lambda x: x["start"] + x["length"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    cleaned = let(F.struct(blocks.alias("blocks"), F.col("__spans").alias("spans"), ends.alias("ends")), marked)
    return rows.withColumn(text, F.when(F.col("__spans").isNotNull(), cleaned).otherwise(F.col(text))).drop("__spans")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate secrets of all documents, with the forest's verdict; values only as digests."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    found = scan(docs, train(labelled_findings(spark, excerpts(docs))))
    return found.select("doc_id", "start", "length", "rule", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
