"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are key blocks up to their end line, values assigned to secret-like
names in any case, tokens behind ``Bearer``, runs of 16 or more token characters with a
digit anywhere, and runs that begin as known tokens do; none has a greatest
length. Features are length, class transitions, bigram and dictionary coverage,
the words before and after the candidate and the path. The forest is trained
from labelled findings (a caller's, or the built-in ones, which are generated
from formats and carry no real secret). Everything on the way from text to
decision is one expression of the row: the trained trees are constant arrays
that a candidate walks down, so nothing is joined or shuffled.

Defined results: null and empty texts have no findings; very long texts are read
whole; a null path is an empty one; repeated rows repeat their findings; a null
id keeps its findings; a score of exactly THRESHOLD is a secret; an empty table
has no findings and is redacted to an empty one; other columns are ignored by
:func:`findings` and kept by :func:`redact`. A value found once is masked wherever
it stands in the text, longer values first.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import quoted

#: Probability from which a candidate is taken for a secret; trees and their depth.
THRESHOLD, TREES, DEPTH = 0.5, 24, 7
#: Characters of the text before and after a candidate that its features see.
BEFORE, AFTER = 48, 24
_CHARS = r"A-Za-z0-9_+/.\-"
_KNOWN = r"(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|eyJ|npm_)"
_NAMES = r"(?:token|secret|passw(?:or)?d|api.?key|access.?key|auth|bearer|credential|private|client.?id)"
#: A secret-like name of any length with its sign of assignment; words before no such sign are left out by the cheap look ahead.
_ASSIGNED = rf"(?<![\w\-])(?=[\w\-]++(?:[ .][\w\-]++)?[\"']?\s*+[:=])(?i:[\w\-]*?{_NAMES})[\w\-]*+[\"']?\s*+[:=]>?\s*+[\"']?"
_BEARER = r"(?<![\w\-])(?i:bearer)\s++"
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY[A-Z ]*?-----(?:(?>[\s\S]*?(?=-----))-----END [A-Z0-9 ]*-----|[A-Za-z0-9+/=\s]*+)"
    rf"|(?:{_ASSIGNED}|{_BEARER})[^\s\"',;]{{8,}}+"
    rf"|(?<![{_CHARS}])(?=[A-Za-z_+/.\-]*+[0-9]|{_KNOWN})[{_CHARS}]{{16,}}+={{0,2}}"
)
_SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|api.?key|access.?key|auth|bearer|credential|private|client.?id)"
_OTHER_WORDS = r"(?i)(sha-?\d*|commit|checksum|hash|digest|md5|uuid|guid|etag|version|build|revision|integrity|example|sample|url|href|src|file|path|mail|phone|tel|iban|card|account|order)"
_TEST_PATH = r"(?i)(^|/)(tests?|examples?|docs?|fixtures?|mocks?|samples?|testdata)(/|$)|\.(md|rst|lock|sum|txt)$"
_WORDS_AFTER = r"(?i)^[^\n]{0,4}\b(example|sample|dummy|fake|placeholder|checksum|hash|digest|commit|fixture|test)"
_PREFIX = r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|eyJ|npm_|-----BEGIN)"
#: Words that identifiers, placeholders and host names are made of.
DICTIONARY = ["access", "account", "address", "admin", "alpha", "application", "archive", "assets", "auth", "backup", "beta", "build", "cache", "change", "chapter", "class", "client", "cloud", "code", "commit", "common", "component", "config", "content", "control", "count", "create", "data", "database", "default", "delete", "demo", "document", "domain", "dummy", "email", "example", "fake", "feature", "field", "file", "final", "function", "group", "handler", "here", "host", "html", "image", "index", "info", "input", "insert", "item", "key", "label", "layout", "letter", "level", "library", "list", "local", "login", "mail", "main", "manager", "message", "method", "model", "module", "name", "network", "number", "object", "office", "option", "order", "output", "overview", "package", "page", "parameter", "pass", "password", "path", "phone", "placeholder", "plugin", "process", "product", "profile", "project", "public", "query", "release", "report", "request", "resource", "response", "result", "sample", "schema", "script", "search", "secret", "section", "server", "service", "session", "setting", "source", "stage", "static", "status", "string", "style", "system", "table", "template", "test", "text", "thread", "time", "token", "tool", "type", "update", "user", "value", "version", "view", "window", "word", "work", "www", "com", "net", "org", "your"]
#: Pairs of letters that words have and random strings seldom have.
_BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"
FEATURES = ["n_chars", "digits", "uppers", "lowers", "marks", "changes", "longest_letters", "distinct", "bigrams", "dictionary", "hex", "only_digits", "dashes", "dots", "prefix", "secret_word", "other_word", "assigned", "quoted", "other_after", "test_path"]


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """FEATURES of a candidate, of the text just before and after it and of its path."""
    n = F.length(value).cast("double")
    count = lambda p: F.regexp_count(value, F.lit(p)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    letters, digits = string.ascii_letters, string.digits
    kinds = F.translate(value, letters + digits, "a" * 26 + "A" * 26 + "0" * 10)
    covered = n - F.length(F.regexp_replace(F.lower(value), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", ""))
    shares = [count("[0-9]") / n, count("[A-Z]") / n, count("[a-z]") / n, count("[^A-Za-z0-9]") / n]
    numbers = [
        F.least(n, F.lit(200.0)), *shares, (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n, F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda s: F.length(s))) / n,
        F.size(F.array_distinct(F.split(F.substring(value, 1, 200), ""))) / F.least(n, F.lit(200.0)), F.regexp_count(F.lower(value), F.lit(f"(?=({_BIGRAMS}))")) / n, covered / n,
        flag(value.rlike("^[0-9a-fA-F]+$")), flag(value.rlike("^[0-9]+$")), count("-") / n, count("[.]") / n, flag(value.rlike(_PREFIX)),
        flag(before.rlike(_SECRET_WORDS + r"[^\n]{0,12}$")), flag(before.rlike(_OTHER_WORDS + r"[^\n]{0,8}$")), flag(before.rlike(r"[:=]\s{0,2}[\"']?$")), flag(before.rlike(r"[\"']$")), flag(after.rlike(_WORDS_AFTER)), flag(path.rlike(_TEST_PATH)),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f) for c, f in zip(numbers, FEATURES, strict=True)]


def labelled_findings(spark: SparkSession, each: int = 60, seed: int = 5) -> DataFrame:
    """``(value, before, after, path, label)``: generated findings, secrets (1) and false positives (0)."""
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    words = [w for w in DICTIONARY if len(w) > 3]
    code = ["src/app/main.py", "lib/client.js", "deploy/env.yaml", "config/settings.ini", "src7", "crawl/part-3", ""]
    away = ["tests/test_client.py", "docs/guide.md", "examples/run.sh", "package-lock.json", "go.sum", *code]
    named = ["token = \"", "TOKEN = \"", "api_key: ", "apiKey = '", "secret=", "client_secret: \"", "password = \"", "Authorization: Bearer ", "aws_secret_access_key = ", "access_key=", "words before token = \"", "auth_token: '"]
    neutral = ["commit ", "sha256:", "checksum = \"", "integrity=\"", "uuid: ", "see ", "version ", "mail ", "href=\"", "the ", "card ", "call ", "\n", "file ", "id=\"", ", "]
    found: list[tuple[str, str, str, int]] = []
    for _ in range(each):
        for value in (some(hexa, 40), some(hexa, 32), some(hexa, 64), some(alnum, rng.randint(20, 48)), some(b64, 40), some(hexa, 40).upper(), some(alnum, 12) + "!" + some(alnum, 6)):
            found.append((value, rng.choice(named), rng.choice(code), 1))
        for value in ("AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(alnum, 36), "sk_live_" + some(alnum, 24), "xoxb-" + some(string.digits, 12) + "-" + some(alnum, 24), "eyJ" + some(alnum, 30) + "." + some(alnum, 60)):
            found.append((value, rng.choice(named + neutral), rng.choice(code), 1))
        dashed = "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12))
        for value in (some(hexa, 40), some(hexa, 64), some(hexa, 32), dashed, "sha512-" + some(b64, 86)):
            found.append((value, rng.choice(["commit ", "sha256:", "checksum = \"", "integrity=\"", "uuid: ", "etag: \"", "revision "]), rng.choice(away), 0))
        name = lambda sep: sep.join(rng.choice(words) for _ in range(rng.randint(2, 4)))
        for value in (name("_") + f"_{rng.randint(1, 99)}", f"{rng.randint(1, 99)}." + name(".") + ".com", f"mail{rng.randint(1, 20)}.{name('.')}.com", name("/") + f"/{rng.randint(1, 2024)}.png", some(string.digits, 16), f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T0{rng.randint(0, 9)}:00".replace(":", "-"), f"{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}-beta.{rng.randint(1000, 9999)}", name("") + str(rng.randint(1, 9)), "+" + some(string.digits, 15)):
            found.append((value, rng.choice(neutral + named[:2]), rng.choice(away), 0))
        for value in ("your_" + name("_") + "_here_123", "x" * rng.randint(14, 24) + "1234", "EXAMPLE" + name("").upper() + "0123", "changeme" + "0" * rng.randint(8, 16), "<" + name("_") + "_1>", "1234567890" * 2, "abcdef" + "0123456789" * 2):
            found.append((value, rng.choice(named), rng.choice(away), 0))
    # without digits, or short: letters at random behind a name, and words in the same place
    letters, later = string.ascii_letters, named + ["Password: ", "Token=", "API_KEY=", "Secret = '", "credentials: \""]
    for _ in range(each):
        for value in (some(letters, rng.randint(16, 40)), some(letters, rng.randint(20, 32)), some(alnum, rng.randint(8, 15)), some(letters, rng.randint(10, 15)), some(alnum, 7) + rng.choice("!#$%&*") + some(alnum, 4)):
            found.append((value, rng.choice(later), rng.choice(code), 1))
        for value in ("AKIA" + some(string.ascii_uppercase, 16), "ghp_" + some(letters, 36)):
            found.append((value, rng.choice(later + neutral), rng.choice(code), 1))
        for value in (rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) + rng.choice(["", "."]) + rng.choice(words), rng.choice(words) + rng.choice("_-.") + rng.choice(words), rng.choice(words) + "()." + rng.choice(words), "sk-" + "-".join(rng.choice(words) for _ in range(3))):
            found.append((value, rng.choice(later), rng.choice(away), 0))
    plain = ["", "\"", "'", "\n", "\" more words", " and so on", "\"\nhost = ", ",", "."]
    told = [" (example)", "\" # sample value", " # dummy", "  checksum ok", "' is a placeholder", " commit"]
    rows = [(v, b, rng.choice(told) if not y and rng.random() < 0.4 else rng.choice(plain), p, y) for v, b, p, y in found]
    return spark.createDataFrame(rows, "value string, before string, after string, path string, label int")


def _assembled(df: DataFrame) -> DataFrame:
    wide = df.select("*", *features(*(F.col(c) for c in ("value", "before", "after", "path"))))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(wide).drop(*FEATURES)


def fit(findings: DataFrame, *, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """Train the forest from ``(value, before, after, path, label)``; a table without ``after`` has it empty."""
    known = findings.filter("value is not null and length(value) > 0 and label in (0, 1)")
    told = [(F.coalesce(F.col(c), F.lit("")) if c in findings.columns else F.lit("")).alias(c) for c in ("before", "after", "path")]
    rows = known.select("value", *told, F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="sqrt", maxBins=64)
    return forest.fit(_assembled(rows).coalesce(1))


@dataclass(frozen=True)
class Forest:
    """The nodes of all trees, one after the other: feature (from one, zero for a leaf), threshold, place of the left and right
    branch (from one) and share of secrets of a leaf; the places of the roots, and the depth of the deepest tree."""

    nodes: list[tuple[int, float, int, int, float]]
    roots: list[int]
    depth: int

    def score(self, x: Column) -> Column:
        """Mean share of secrets in the leaves that the features ``x`` (an array) fall into, as the model's probability."""
        feature, threshold, left, right, share = (_constants(c, t) for c, t in zip(zip(*self.nodes, strict=True), ("int", "double", "int", "int", "double"), strict=True))

        def step(node: Column, _: Column) -> Column:
            down = F.when(F.element_at(x, F.element_at(feature, node)) <= F.element_at(threshold, node), F.element_at(left, node)).otherwise(F.element_at(right, node))
            return F.when(F.element_at(feature, node) == 0, node).otherwise(down)

        levels = F.sequence(F.lit(1), F.lit(max(1, self.depth)))
        leaves = F.transform(_constants(self.roots, "int"), lambda root: F.element_at(share, F.aggregate(levels, root, step)))
        return F.aggregate(leaves, F.lit(0.0), lambda a, b: a + b) / len(self.roots)


def _constants(values, kind: str) -> Column:
    """An array of constants, folded once by the optimiser."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def unrolled(model: RandomForestClassificationModel) -> Forest:
    """The trained trees as plain arrays."""
    nodes: list = []
    deepest = 0

    def add(node, depth: int) -> int:
        nonlocal deepest
        deepest = max(deepest, depth)
        at = len(nodes)
        nodes.append(None)
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            nodes[at] = (0, 0.0, 0, 0, float(stats[1] / sum(stats)))
        else:
            split = node.split()
            nodes[at] = (int(split.featureIndex()) + 1, float(split.threshold()), add(node.leftChild(), depth + 1), add(node.rightChild(), depth + 1), 0.0)
        return at + 1

    roots = [add(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree.rootNode(), 0) for tree in model.trees]
    return Forest(nodes, roots, deepest)


def _may_hold(text: Column) -> Column:
    """What every text with a candidate has; far cheaper to test than the pattern."""
    return text.rlike("[0-9]") | text.contains("-----BEGIN") | text.rlike(_KNOWN) | text.rlike(f"(?i){_NAMES}")


def _found(text: Column) -> Column:
    """``array<struct<value, before, after>>``: every candidate in order of its place in the text."""
    between = F.split(text, CANDIDATE, -1)
    # there is one stretch more between candidates than candidates
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("all"), F.transform(between, lambda s: F.right(s, F.lit(BEFORE))).alias("before"), F.slice(F.transform(between, lambda s: F.left(s, F.lit(AFTER))), F.lit(2), F.size(between)).alias("after"))
    cut = F.transform(F.filter(zipped, lambda z: z["all"].isNotNull()), lambda z: F.struct(z["all"].alias("all"), F.regexp_extract(z["all"], rf"^(?:{_ASSIGNED}|{_BEARER})", 0).alias("name"), z["before"].alias("before"), z["after"].alias("after")))
    return F.transform(cut, lambda z: F.struct(F.substring(z["all"], F.length(z["name"]) + 1, F.length(z["all"])).alias("value"), F.right(F.concat(z["before"], z["name"]), F.lit(BEFORE)).alias("before"), z["after"].alias("after")))


def _judged(text: Column, path: Column, forest: Forest) -> Column:
    """``array<struct<value, before, after, score>>`` of the candidates, or null without any."""
    path = F.coalesce(path.cast("string"), F.lit(""))
    numbers = F.transform(_found(text), lambda c: F.struct(c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"), F.array(*features(c["value"], c["before"], c["after"], path)).alias("x")))
    scored = F.transform(numbers, lambda c: F.struct(c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"), forest.score(c["x"]).alias("score")))
    return F.when(_may_hold(text) & text.rlike(CANDIDATE), scored)


def _forest(spark: SparkSession, model: RandomForestClassificationModel | None) -> Forest:
    return unrolled(model or fit(labelled_findings(spark)))


def findings(docs: DataFrame, model: RandomForestClassificationModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """``(id_col, path, ordinal, value, before, after, score, is_secret)`` of every candidate."""
    where = F.coalesce((F.lit("") if path is None else path).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), where.alias("path"), F.posexplode(_judged(F.col(text_col), where, _forest(docs.sparkSession, model))).alias("ordinal", "found"))
    return found.select(F.col("id").alias(id_col), "path", "ordinal", "found.value", "found.before", "found.after", "found.score", (F.col("found.score") >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced in its text, columns as they were; decided in the row, without a join."""
    text = F.col(text_col)
    judged = _judged(text, F.lit("") if path is None else path, _forest(docs.sparkSession, model))
    values = F.array_distinct(F.transform(F.filter(judged, lambda c: c["score"] >= THRESHOLD), lambda c: c["value"]))
    longest_first = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    hidden = F.aggregate(longest_first, text, lambda t, s: F.replace(t, s, F.lit(mask)))
    return docs.select(*[F.coalesce(hidden, text).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns])
