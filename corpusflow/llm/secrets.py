"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

DataFrame and SQL functions only, on the cluster and in training.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters looked at on each side for neighbouring words; the name of an assigned value is seen whole besides.
CONTEXT = 60
THRESHOLD = 0.5
#: Bound of the training sample: labelled findings used, those with the smallest hash.
MAX_FINDINGS = 20_000
TREES = 20
DEPTH = 6

# Words that name secrets, words that name other long strings, words of sample code.
SECRET_WORDS = (
    "password passwd pwd passphrase secret token apikey api_key access_key private_key auth authorization bearer "
    "credential credentials client_secret signature session"
).split()
#: Characters of names and tokens. A name starts where no such character is in front of it.
_NAME = r"[A-Za-z0-9+/_\-]"
_START = rf"(?<!{_NAME})"
#: A candidate of its own: 12 or more token characters with a digit.
TOKEN = rf"(?=[A-Za-z+/_\-]*+[0-9]){_NAME}{{12,}}+={{0,2}}"
_SIGN = r"(?::=|=>|={1,3}|:)"
# A secret word anywhere in a name, with no small letter behind it ("secretary" names none).
_SECRET_NAME = rf"(?={_NAME}*?(?i:" + "|".join(SECRET_WORDS).replace("_", "[_\\-]?") + r")(?![a-z]))"
# A name of any length and a sign with any spacing: what stands in front of an assigned value. The cheap test of the sign is first.
_PREFIX = rf"(?={_NAME}++[\"'\]]{{0,2}}\s*+[:=]){_SECRET_NAME}{_NAME}++[\"'\]]{{0,2}}\s*+{_SIGN}\s*+(?!-----BEGIN )"
#: The value assigned to a secret word, of any length and characters: up to its quote, or to white space without one.
ASSIGNED = _PREFIX + "(?:" + "|".join([rf"{q}(?!-----BEGIN )[^\s{q}]++" for q in "\"'`"] + [r"[^\s\"'`=>:][^\s\"'`]*+"]) + ")"
#: The password in the address of a server.
_ADDRESS = r"://[^\s/:@\"'`]*+:"
URL_PASSWORD = _ADDRESS + r"[^\s/@\"'`]++(?=@)"
#: A block that holds a private key, up to its end line, or to the next line of five hyphens without one.
KEY_BLOCK = r"-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY(?: BLOCK)?-----(?:[^\-]++|-(?!----))*+(?:-----END [A-Z0-9 ]*+-----)?"
#: All forms, read forward in one pass: possessive repeats keep it linear in the text. Forms hold what stands in front of the value.
CANDIDATE = f"{KEY_BLOCK}|{URL_PASSWORD}|{_START}(?:{ASSIGNED}|{TOKEN})"
#: What of a match stands in front of the value.
IN_FRONT = rf"^(?:{_ADDRESS}|{_PREFIX}(?:[\"'`](?=.)|(?=[^=>:])))"
#: Closing marks of a sentence or a bracket that are not part of a value without quotes.
_CLOSING = ".,;)]}"
OTHER_WORDS = (
    "sha sha1 sha256 md5 checksum hash commit revision digest uuid guid id isbn issn doi order invoice phone tel fax card "
    "account serial version build release date time timestamp number page image file url path"
).split()
SAMPLE_WORDS = (
    "example sample test testing dummy fake mock placeholder changeme your insert redacted default demo todo foo bar "
    "fixture fixtures lorem ipsum"
).split()
#: Words of the dictionary whose share of a candidate is measured.
DICTIONARY = tuple(
    sorted(
        {
            *SECRET_WORDS, *OTHER_WORDS, *SAMPLE_WORDS,
            *(
                "the and for with from that this have will not are was were you all can has one two new use used user data "
                "name list item value key index page image photo post blog news site html http https www com org net src "
                "lib bin doc docs main class function public static void return string int float double array object map "
                "set get put size length type node tree text word line json xml csv log error info debug start end first "
                "last next prev left right top bottom color font style width height content article section chapter model "
                "large small base train valid epoch batch layer config server client request response"
            ).split(),
        }
    )
)

FEATURES = (
    "length", "transitions", "dictionary", "digits", "upper", "lower", "variety", "hex", "ordinary",
    "secret_before", "other_before", "sample_near", "assigned", "quoted", "path_sample", "path_depth", "address",
    "block",
)


def _share(text: Column, pattern: str) -> Column:
    """Share of the characters of ``text`` that ``pattern`` matches."""
    return 1 - F.length(F.regexp_replace(text, F.lit(pattern), F.lit(""))) / F.greatest(F.length(text), F.lit(1))


def _any_word(text: Column, words: list[str]) -> Column:
    # (?<![a-z]) and (?![a-z]) keep the words apart from longer ones, also beside digits and underscores.
    return F.lower(text).rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])").cast("double")


def feature_struct(candidate: Column, left: Column, right: Column, path: Column) -> Column:
    """Numbers about a candidate, its neighbouring words and the path of its file, in one struct."""
    head = candidate
    classes = reduce(
        lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])),
        (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^a-zA-Z0-9]+", "-")),
        head,
    )
    words = F.regexp_extract_all(F.lower(head), F.lit("[a-z]{3,}"), F.lit(0))
    in_words = F.aggregate(
        words, F.lit(0), lambda total, w: total + F.when(w.isin(*DICTIONARY), F.length(w)).otherwise(0)
    )
    before = F.regexp_extract(left, r"((?:\S+\s+){0,2}\S*)$", 1)
    after = F.regexp_extract(right, r"^(\S*(?:\s+\S+){0,2})", 1)
    values = {
        "length": F.length(candidate).cast("double"),
        # Each run of one class is one character of ``classes``.
        "transitions": (F.length(classes) - 1) / F.greatest(F.length(head), F.lit(1)),
        "dictionary": in_words / F.greatest(F.length(head), F.lit(1)),
        "digits": _share(head, "[0-9]"),
        "upper": _share(head, "[A-Z]"),
        "lower": _share(head, "[a-z]"),
        "variety": F.size(F.array_distinct(F.split(head, ""))) / F.greatest(F.length(head), F.lit(1)),
        "hex": head.rlike("^[0-9a-f]+$").cast("double"),
        # Single words, calls and attributes of program code, and values that are masked.
        "ordinary": head.rlike(r"^\p{Lu}?\p{Ll}{0,15}$|^[A-Z]{1,8}$|[(){}\[\]<>$]|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$|^[*.xX#\-]+$").cast("double"),
        "secret_before": _any_word(before, SECRET_WORDS),
        "other_before": _any_word(before, OTHER_WORDS),
        "sample_near": F.greatest(_any_word(before, SAMPLE_WORDS), _any_word(after, SAMPLE_WORDS), _any_word(head, SAMPLE_WORDS)),
        "assigned": left.rlike(r"[:=]>?\s*[\"'`]?$").cast("double"),
        "quoted": left.rlike(r"[\"'`]$").cast("double"),
        "path_sample": _any_word(path, SAMPLE_WORDS),
        "path_depth": _count(path, "/").cast("double"),
        "address": left.rlike(r"://[^\s/:@]*:$").cast("double"),
        "block": head.startswith("-----BEGIN ").cast("double"),
    }
    return F.struct(*[F.coalesce(values[n], F.lit(0.0)).cast("double").alias(n) for n in FEATURES])


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


@dataclass(frozen=True)
class Node:
    """A leaf with a class, or a test of one feature."""

    label: int = 0
    feature: str = ""
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def votes(self, x: Column) -> Column:
        if self.low is None or self.high is None:
            return F.lit(float(self.label))
        return F.when(x[self.feature] <= self.limit, self.low.votes(x)).otherwise(self.high.votes(x))


_TEST = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)|Predict: ([\d.]+)")


def _trees(description: str) -> list[Node]:
    """The trees of a fitted forest, from the description that Spark prints of it."""
    trees = []
    for part in re.split(r"\n\s*Tree \d+.*", description)[1:]:
        steps = iter(_TEST.findall(part))

        def node() -> Node:
            word, feature, _, limit, label = next(steps)
            if not word:
                return Node(int(float(label)))
            low = node()
            next(steps)  # the Else of the same test
            return Node(0, FEATURES[int(feature)], float(limit), low, node())

        trees.append(node())
    return trees


def fit_forest(findings: DataFrame, max_findings: int = MAX_FINDINGS, trees: int = TREES, depth: int = DEPTH, seed: int = 17) -> list[Node]:
    """Random forest on labelled findings (candidate, before, after, path, is_secret).

    Findings with a null candidate or label are not learned from; at most
    ``max_findings`` are, those with the smallest hash. The trees come back as
    small tests on features, to be evaluated as column expressions.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = findings.filter("candidate is not null and is_secret is not null")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = known.orderBy(F.xxhash64("candidate", "before", "after", "path"), "candidate", "is_secret").limit(max_findings)
    rows = known.select(
        feature_struct(F.col("candidate"), empty("before"), empty("after"), empty("path")).alias("x"),
        F.col("is_secret").cast("double").alias("label"),
    ).select("x.*", "label")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    classifier = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return _trees(classifier.fit(rows).toDebugString)


def score(x: Column, forest: list[Node]) -> Column:
    """Share of the trees that call a candidate a secret."""
    return reduce(lambda a, b: a + b, [tree.votes(x) for tree in forest]) / float(len(forest))


def public_findings(spark: SparkSession, rows: int = 10_800) -> DataFrame:
    """Labelled findings made by rule from hashed numbers, in public formats.

    Secrets: cloud key ids, hex and base64 tokens and passwords, mostly behind a
    word that names them or an assignment; short passwords with and without
    punctuation, tokens without digits, passwords in addresses and blocks of
    private keys. Others: payment card and order
    numbers, commit and file hashes, UUIDs, dates, versions, identifiers of
    code, placeholders, words of prose and code behind an assignment, and
    anything in sample files.
    """
    # spark.range in a fixed number of slices makes the training set the same everywhere.
    base = spark.range(0, rows, 1, 4).select("id", F.sha2(F.concat(F.lit("finding"), F.col("id")), 512).alias("h"))
    base = base.withColumn("kind", F.col("id") % 36).withColumn("pick", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))

    def pick(words: list[str], step: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(F.col("pick") / step) % len(words) + 1).cast("int"))

    def digits(n: int) -> Column:
        return F.substring(F.translate("h", "abcdef", "123456"), 1, n)

    hexes = lambda a, n: F.substring("h", a, n)
    base64 = F.translate(F.substring(F.base64(F.unhex("h")), 1, 40), "=", "")
    prose = pick(["the same of", "and then", "is here", "was found.", "see also", "und der", "dans le", "por la", "of it,", "in"], 1)
    name = pick([w for w in SECRET_WORDS if w not in ("signature", "session")], 7)
    sign = pick(["=", " = \"", ": ", ":\"", " = '", "=\""], 13)
    other = pick(OTHER_WORDS, 7)
    code = pick(["user_profile_image_", "article-section-", "config/server/v", "data_index_list_", "train_batch_size_", "page-content-width-"], 3)
    sample = pick(["example", "your_api_key_", "test_token_", "changeme", "dummy", "placeholder_"], 3)
    upper_key = F.upper(F.translate(F.substring(F.base64(F.unhex("h")), 1, 24), "+/=", "QZX"))
    key_id = F.concat(pick(["AKIA", "ASIA", "AKIA", "AGPA"], 5), F.substring(upper_key, 1, 16))
    assigned = F.concat(prose, F.lit(" "), name, sign)
    uuid = F.concat_ws("-", hexes(1, 8), hexes(9, 4), hexes(13, 4), hexes(17, 4), hexes(21, 12))
    plain_path = pick(["src3", "src/app/main.py", "web/config/prod.yml", "notes/readme.md", "", "deploy/env/settings.ini"], 11)
    letters = F.translate(base64, "+/0123456789", "gkmpqrsTVWXZ")
    blocks = F.concat(F.lower(F.substring(letters, 1, 9)), F.upper(F.substring(letters, 10, 6)), F.lower(F.substring(letters, 16, 20)))
    letters = F.when(F.col("pick") % 2 == 0, blocks).otherwise(letters)
    word = pick(["hunter", "dragon", "monkey", "winter", "purple", "falcon", "soleil", "katze", "Summer", "Tiger", "Secret", "Troubador"], 17)
    leet = F.when(F.col("pick") % 3 == 0, F.translate(word, "aeo", "430")).otherwise(word)
    symbol = pick(["!", "&", "#", "@", "%", "?", "*", "!!", "$", "^", "+", "="], 29)
    tail = pick(["pass", "", "xyz", "Aa", "q", "ville"], 37)
    # Words of no language, of letters only.
    sounds = F.translate(F.expr("substring(h, 9, int(2 + pick % 10))"), "0123456789", "ghijklmnop")
    said = pick(["the", "required", "must", "none", "null", "true", "false", "string", "your", "Optional", "invalid", "is", "a", "and", "expired", "Bearer", "None", "NULL"], 17)
    program = pick(["os.environ[", "getpass()", "config.", "${", "<", "self.", "process.env.", "{{", "request.headers[", "input(", "****", "$("], 17)
    inner = pick(["password>", "token", "auth", "DB_PASSWORD}", "********", "secret)", "api_key", "get("], 41)
    call = pick(["getpass(", "input(", "get_token(", "getpass.getpass(", "read_secret(", "load(path", "config.get(", "prompt(", "fetch()", "env(", "f(x"], 23)
    program = F.when(F.col("pick") % 2 == 0, call).otherwise(F.concat(program, inner))
    user = F.concat(prose, F.lit(" "), pick(["postgres", "https", "redis", "amqp", "mongodb+srv", "ftp"], 19), F.lit("://"), pick(["admin", "app", "root", "", "svc"], 31), F.lit(":"))
    kind = pick(["RSA ", "", "EC ", "OPENSSH ", "ENCRYPTED "], 43)
    body = F.concat_ws("\n", *[F.substring(F.base64(F.unhex(F.sha2(F.concat("h", F.lit(str(n))), 512))), 1, 64) for n in range(6)])
    lines = F.when(F.col("pick") % 2 == 0, body).otherwise(F.substring(body, 1, 64))
    block = F.concat(F.lit("-----BEGIN "), kind, F.lit("PRIVATE KEY-----\n"), lines, F.lit("\n-----END "), kind, F.lit("PRIVATE KEY-----"))
    masked = pick(["password", "pass", "changeme", "****", "your_password", "${DB_PASSWORD}", "<password>", "xxxx", "{password}", "example"], 47)
    made = [  # candidate, before, label
        (hexes(1, 40), assigned, 1), (hexes(1, 18), assigned, 1), (hexes(5, 32), assigned, 1), (base64, assigned, 1),
        (F.expr("substring(h, 1, int(12 + pick % 29))"), assigned, 1), (key_id, F.concat(prose, F.lit(" ")), 1),
        (key_id, assigned, 1), (F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)), F.concat(prose, F.lit(" ")), 1),
        (F.concat(F.lit("sk_live_"), hexes(3, 24)), F.concat(prose, F.lit(" ")), 1), (base64, F.concat(prose, F.lit(" "), name, F.lit(" ")), 1),
        (digits(16), F.concat(prose, F.lit(" ")), 0), (digits(13), F.concat(prose, F.lit(" "), other, F.lit(" ")), 0),
        (hexes(1, 40), F.concat(prose, F.lit(" "), other, sign), 0), (hexes(1, 32), F.concat(other, F.lit(" ")), 0),
        (uuid, F.concat(prose, F.lit(" "), other, F.lit(" ")), 0), (F.concat(code, digits(3)), F.concat(prose, F.lit(" ")), 0),
        (F.concat(sample, digits(6)), assigned, 0), (F.concat(F.lit("2024-0"), digits(1), F.lit("-1"), digits(1), F.lit("T10-00-0"), digits(1)), F.concat(prose, F.lit(" ")), 0),
        (F.concat(hexes(1, 8), F.lit("XXXXXXXXXXXX")), assigned, 0), (hexes(1, 40), assigned, 0),
        (F.concat(leet, symbol, hexes(3, 2)), assigned, 1), (F.concat(leet, digits(1), tail), assigned, 1),
        (F.concat(leet, digits(2), symbol), assigned, 1), (F.concat(F.substring(base64, 1, 5), symbol, F.substring(base64, 9, 3)), assigned, 1),
        (F.expr("substring(h, 1, int(6 + pick % 6))"), assigned, 1), (F.substr(letters, F.lit(1), (14 + F.col("id") % 19).cast("int")), assigned, 1),
        (F.substring(base64, 3, 8), assigned, 1), (F.concat(F.substring(letters, 1, 4), symbol, F.substring(letters, 7, 6)), assigned, 1),
        (said, assigned, 0), (F.when(F.col("pick") % 2 == 0, sounds).otherwise(F.initcap(sounds)), assigned, 0),
        (program, assigned, 0), (digits(2), assigned, 0),
        (block, F.when(F.col("pick") % 3 == 0, assigned).otherwise(F.concat(prose, F.lit("\n"))), 1),
        (F.concat(leet, symbol, tail), user, 1), (F.concat(F.substring(base64, 1, 6), hexes(3, 4)), user, 1), (masked, user, 0),
    ]

    def choose(column: int) -> Column:
        out = F.when(F.col("kind") == 0, made[0][column])
        for k in range(1, len(made)):
            out = out.when(F.col("kind") == k, made[k][column])
        return out

    label = F.col("kind").isin(*[k for k, m in enumerate(made) if m[2]])
    path = F.when(F.col("kind") == 19, pick(["tests/fixtures/keys.py", "examples/demo.py", "docs/sample.md", "src/test/mock_client.java"], 3)).otherwise(plain_path)
    closing = F.when(F.col("before").rlike("\"$"), F.lit('" ')).when(F.col("before").rlike("'$"), F.lit("' ")).otherwise(F.lit(" "))
    return base.select("kind", "pick", choose(0).alias("candidate"), choose(1).alias("before"), path.alias("path"), label.alias("is_secret")).select(
        "candidate", "before", F.concat(closing, prose).alias("after"), "path", "is_secret"
    )


def _left(before: Column, front: Column) -> Column:
    """CONTEXT characters in front of a match, and the name and sign of its value with single spaces."""
    return F.concat(F.right(before, F.lit(CONTEXT)), F.regexp_replace(front, r"\s+", " "))


def _value(match: Column, n: Column) -> Column:
    """front, value and end of a match whose value starts after ``n`` characters."""
    front, rest = F.left(match, n), F.substr(match, n + 1)
    # Marks at the end of a value go to the text behind it, unless it is quoted or nothing would be left.
    bare = (n > 0) & ~front.rlike("[\"'`]$") & ~front.startswith("://")
    short = F.rtrim(rest, F.lit(_CLOSING))
    value = F.when(bare & (F.length(short) > 0), short).otherwise(rest)
    return F.struct(front.alias("front"), value.alias("value"), F.substr(rest, F.length(value) + 1).alias("end"))


def _scanned(docs: DataFrame, forest: list[Node], text: str, path: str | None) -> DataFrame:
    """``docs`` with __parts: for each candidate the text before it, itself and its score; the rest of the text last.

    Arrays enter the lambdas as arguments, so each text is split once however many candidates it has.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.withColumn("__found", F.regexp_extract_all(value, F.lit(CANDIDATE), F.lit(0))).withColumn("__path", where)
    between = F.when(F.size("__found") > 0, F.split(value, CANDIDATE, -1)).otherwise(F.array(value))
    rows = rows.withColumn("__between", between)
    # A match is what stands in front of a value, the value, and closing marks behind one without quotes.
    front = lambda m: F.regexp_extract(m, IN_FRONT, 0)
    split = F.transform("__found", lambda m: F.struct(m.alias("m"), F.length(front(m)).alias("n")))
    rows = rows.withColumn("__found", split).withColumn("__found", F.transform("__found", lambda f: _value(f["m"], f["n"])))
    # The text between two values: closing marks of the one, what was between the matches, and the front of the other.
    rows = rows.withColumn("__hit", F.transform("__found", lambda f: f["value"]))
    ends = F.concat(F.array(F.lit("")), F.transform("__found", lambda f: f["end"]))
    fronts = F.concat(F.transform("__found", lambda f: f["front"]), F.array(F.lit("")))
    rows = rows.withColumn("__before", F.zip_with(ends, "__between", lambda e, g: F.concat(F.coalesce(e, F.lit("")), F.coalesce(g, F.lit("")))))
    rows = rows.withColumn("__gap", F.zip_with("__before", fronts, lambda g, f: F.concat(g, F.coalesce(f, F.lit("")))))
    rows = rows.withColumn("__front", fronts)
    rows = rows.withColumn("__next", F.slice("__gap", F.lit(2), F.size("__gap")))
    known = F.transform(
        F.arrays_zip("__hit", "__gap", "__next", "__before", "__front"),
        lambda x: F.struct(
            x["__gap"].alias("gap"),
            x["__hit"].alias("hit"),
            F.when(
                x["__hit"].isNotNull(),
                feature_struct(
                    x["__hit"], _left(x["__before"], x["__front"]), F.left(F.coalesce(x["__next"], F.lit("")), F.lit(CONTEXT)),
                    F.col("__path"),
                ),
            ).alias("x"),
        ),
    )
    parts = F.transform(
        known,
        lambda y: F.struct(
            y["gap"].alias("gap"), y["hit"].alias("hit"), F.when(y["hit"].isNotNull(), score(y["x"], forest)).alias("score")
        ),
    )
    return rows.withColumn("__parts", parts).drop(
        "__hit", "__gap", "__next", "__path", "__found", "__between", "__before", "__front"
    )


def findings(
    docs: DataFrame, forest: list[Node], threshold: float = THRESHOLD, text: str = "text", path: str | None = "source"
) -> DataFrame:
    """Secrets that the forest confirms: doc_id, number, start, length, score, sha256, preview.

    ``number`` counts the candidates of a document row from 1, ``start`` is the
    character place from 0. The value itself is not returned, only its SHA-256
    and its first four characters (a quarter of a value under 12). Null or empty texts hold nothing; a null or
    missing path says nothing; repeated rows are reported each; empty tables
    give none. Other columns of ``docs`` are not looked at.
    """
    source = F.col(path).cast("string") if path else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), source.alias("path"))
    # No filter on the parts here: it would be pushed below them and scan every text a second time.
    rows = _scanned(rows, forest, "text", "path")
    # Characters up to each candidate: small rows of one document meet, never texts.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "row", F.posexplode("__parts").alias("number", "part"))
    rows = rows.select(
        "doc_id", "row", F.col("number") + 1, F.length("part.gap").alias("gap"), F.length("part.hit").alias("length"),
        F.col("part.score").alias("score"), F.sha2("part.hit", 256).alias("sha256"),
        F.left("part.hit", F.when(F.length("part.hit") >= 12, 4).otherwise(F.floor(F.length("part.hit") / 4).cast("int"))).alias("preview"),
    ).toDF("doc_id", "row", "number", "gap", "length", "score", "sha256", "preview").filter("length is not null")
    before = Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum(F.col("gap") + F.col("length")).over(before) - F.col("length"))
    return rows.filter(F.col("score") >= threshold).select("doc_id", "number", "start", "length", "score", "sha256", "preview")


def redacted(
    docs: DataFrame, forest: list[Node], threshold: float = THRESHOLD, mark: str = "[SECRET]", text: str = "text",
    path: str | None = "source",
) -> DataFrame:
    """``docs`` with every confirmed secret of ``text`` replaced by ``mark``; nothing else changes, null stays null.

    A row-wise plan without any shuffle. ``path`` names a column of ``docs`` or
    is None; a column that is not there raises an error.
    """
    rows = _scanned(docs, forest, text, path)
    joined = F.array_join(
        F.transform(
            "__parts",
            lambda y: F.concat(
                y["gap"], F.when(y["score"] >= threshold, F.lit(mark)).otherwise(F.coalesce(y["hit"], F.lit("")))
            ),
        ),
        "",
    )
    # Texts without candidates pass through as they are.
    value = F.when(F.col(text).isNotNull() & (F.size("__parts") > 1), joined).otherwise(F.col(text))
    return rows.withColumn(text, value).select(*docs.columns)
