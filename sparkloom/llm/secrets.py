"""Secret scans: candidates by pattern, false positives removed by a random forest, in built-in SQL functions only.

A candidate is any run of 16 or more characters of the key alphabets inside a word. Its features are its length, the
transitions between character classes, dictionary coverage, path-like shape, the document's path and the words around
it. A small random forest, fitted on the driver from a bounded set of labelled findings, travels as three literal arrays
(split features, thresholds, leaf shares) that built-in array functions walk; scanning is one pass per document with no
shuffle and no Python on the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.quality import let, words_of

LEAST = 16
MASK = "[SECRET]"
RUN = r"[A-Za-z0-9+/_~.\-]{16,}={0,2}"
#: A name of words of one case, with its sign where that is in the run, and what may stand between a name and its value.
NAME = r"^([A-Z]+|[A-Z]?[a-z]+)([_.\-]([A-Z]+|[A-Z]?[a-z]+|[0-9]{1,2}))+(=?)\x00"
ASSIGNS = r"(=\x00[\"']?|\x00[\"']?[:=][\"']?)$"
# Common words and endings of English, German, French and Spanish prose, and of identifiers.
DICTIONARY = (
    "the and ing ion tion ation ment ness able ible ful less ous ive ity ally ence ance ent ant ter ver her his hat ith "
    "was for are not but all can had one our out you with have this from they will would there their what about which when make like time just "
    "know take people into year your good some could them see other than then now look only come its over think also back after use two how work "
    "first well way even new want because any these give day most der die und den von das mit sich des auf für ist dem nicht ein eine als auch "
    "lich keit heit ung sch isch bar haft chen lein ge be er ent ver zer aus ab an les des une que pour dans qui sur pas plus par avec ont eau "
    "eaux eux aille elle ment esse ique los las por con para como más pero sus este entre cuando ción dad mente ado ada ido ida oso osa "
    "example config string default public static context request response number service function com org net www http https html index page image "
    "file path user name test data type list item code date size text view main get set value error class object return import server client local host "
    "mail port key id in on at of or re th en es ed nd st ou ea ha ti al ar it le de is to an he"
).split()
NEAR = r"token|secret|passw|passwd|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private|key"
FAR = r"sha|md5|hash|commit|checksum|digest|uuid|guid|version|revision|build|etag|path|file|http|www|href|src"
FEATURES = (
    "n_chars", "transitions", "digit_share", "upper_share", "hex", "coverage", "vowel_share", "separators", "known",
    "near", "far", "assigned", "quoted", "doc_path", "runs",
)
#: What invented findings are made of, and their shapes.
NAMES = ["token", "api_key", "secret", "password", "auth_token", "access_key", "credential", "private_key"]
LATIN = "the and tion ing er re on an th ed es in or at en st nd ha ou ti ea le wh".split()
OTHER = "lich keit heit ung sch ein ber ver ge ch tz st er en eau eux aille ment tion que oi re ciones ado osa mente rr ll".split()
REAL = [
    '<name> = "<hex40>"', "<name>: <hex32>", '<NAME> = "<HEX40>"', "<name>=<c32>", "<word> AKIA<C16> <mot>", "<word> ghp_<c36>", "<name> sk-<c60>",
    "Authorization: Bearer eyJ<c60>", "<name> is '<b64>'", "<name> <hex40> <mot>", "export <NAME>=<c36>", '{"<name>":"<c32>","user":"<word>"}', "<name>=<hex32>&user=<word>",
]
FALSE = [
    "<word> <long> <mot>", "<mot> <lang>. <word>", "see /usr/share/<long>/<lang>.txt here", "at https://www.<long>.example.com/<word>", "<word> mail<no>.example.com <mot>",
    "commit <hex40> <word>", "sha256 checksum <hex64>", "<word> <num> <mot>", "<name> = get_<long>_value()", "<name> = xxxxxxxxxxxxxxxxxxxxxxxx", "uuid <uuid> <word>",
    "<word> ============================ <mot>", "<word> <LANG> <name>", "<name> <long> <word>", "<mot> <lang>-<long> <word>", "from <long>.<lang> import <word>",
]
#: Public prefixes of issued keys.
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|glpat-|eyJ|npm_|SG\.)"


def _share(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")) / F.length(text)


def features(cand: Column, around: Column, path: Column) -> Column:
    """A struct of FEATURES, all doubles, for a candidate, the words around it (lower case) and the document's path."""
    changes = r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^a-zA-Z0-9](?=[a-zA-Z0-9])"
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    low = F.lower(cand)
    return F.struct(
        F.length(cand).cast("double").alias("n_chars"),
        (F.regexp_count(cand, F.lit(changes)) / F.length(cand)).alias("transitions"),
        _share(cand, "0-9").alias("digit_share"),
        _share(cand, "A-Z").alias("upper_share"),
        flag(cand.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        (1.0 - F.length(F.regexp_replace(low, "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), "")) / F.length(cand)).alias("coverage"),
        _share(low, "aeiou").alias("vowel_share"),
        (F.length(F.regexp_replace(cand, r"[^/.\-_]+", "")) / F.length(cand)).alias("separators"),
        flag(cand.rlike(KNOWN)).alias("known"),
        flag(around.rlike(NEAR)).alias("near"),
        flag(around.rlike(FAR)).alias("far"),
        flag(around.rlike(r"[=:]\s*[\"']?\x{1}")).alias("assigned"),
        flag(around.rlike(r"[\"']\x{1}")).alias("quoted"),
        flag(F.lower(F.coalesce(path, F.lit(""))).rlike("test|example|doc|sample|fixture|readme")).alias("doc_path"),
        flag(cand.rlike(r"(.)\1{3}")).alias("runs"),
    )


def candidates(text: Column, path: Column) -> Column:
    """An array of (word_index, value, f) of every candidate of a text: each run of a word, in order.

    A name that stands before another run of its word as the name of its value is none.
    """

    def one(words: Column, i: Column, gaps: Column, values: Column, j: Column) -> Column:
        # Around the first run stand the words before, around a later one the run before it, each with what lies between.
        before = F.when(j > 0, F.get(values, j - 1)).otherwise(
            F.concat(F.concat_ws(" ", F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))), F.lit(" "))
        )
        behind = F.when(j + 1 < F.size(values), F.lit("")).otherwise(F.concat(F.lit(" "), F.coalesce(F.get(words, i + 1), F.lit(""))))
        # \x01 stands for the candidate among the words around it.
        around = F.lower(F.concat(before, F.get(gaps, j), F.lit("\x01"), F.get(gaps, j + 1), behind))
        both = F.struct(F.get(values, j).alias("v"), around.alias("a"))
        return let(both, lambda x: F.struct(i.cast("long").alias("word_index"), x["v"].alias("value"), features(x["v"], x["a"], path).alias("f")))

    def names_next(gaps: Column, values: Column, j: Column) -> Column:
        pair = F.concat(F.get(values, j), F.lit("\x00"), F.get(gaps, j + 1))
        return (j + 1 < F.size(values)) & pair.rlike(NAME) & pair.rlike(ASSIGNS)

    def each(words: Column, i: Column) -> Column:
        word = F.get(words, i)
        both = F.struct(F.split(word, RUN, -1).alias("gaps"), F.regexp_extract_all(word, F.lit(RUN), F.lit(0)).alias("values"))
        runs = lambda x: F.filter(F.sequence(F.lit(0), F.size(x["values"]) - 1), lambda j: ~names_next(x["gaps"], x["values"], j))
        return let(both, lambda x: F.transform(runs(x), lambda j: one(words, i, x["gaps"], x["values"], j)))

    def found(words: Column) -> Column:
        long = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.length(F.get(words, i)) >= LEAST)
        runs = F.filter(long, lambda i: F.get(words, i).rlike(RUN))
        return F.when(F.size(words) > 0, F.flatten(F.transform(runs, lambda i: each(words, i))))

    return let(words_of(text), found)


def labelled_findings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """(text, path, label): one invented finding a row, made from hashes of its number; 1 is a secret. `n` may be 0.

    Real keys: hexadecimal and base64 tokens, prefixed keys and passwords near their names. False positives: long words
    of several syllable sets, paths, addresses, hosts, digests of files and commits, identifiers, placeholders.
    """
    i = F.col("id")
    number = lambda s, m, *more: (F.pmod(F.xxhash64(i, F.lit(s), *more), F.lit(m)) + 1).cast("int")
    pick = lambda s, xs, *more: F.element_at(F.split(F.lit("|".join(xs)), r"\|"), number(s, len(xs), *more))
    glued = lambda s, k, xs: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: pick(s, xs, j)), "")
    digits = F.sha2(i.cast("string"), 256)
    clean64 = F.translate(F.concat(F.base64(F.unhex(digits)), F.base64(F.md5(digits).cast("binary"))), "+/=", "xyz")
    parts = {
        "<name>": pick("n", NAMES), "<NAME>": F.upper(pick("n", NAMES)), "<hex64>": digits, "<hex40>": F.substring(digits, 1, 40), "<hex32>": F.substring(digits, 1, 32),
        "<HEX40>": F.upper(F.substring(digits, 1, 40)), "<uuid>": F.regexp_replace(F.substring(digits, 1, 32), "^(.{8})(.{4}).(.{3}).(.{3})", "$1-$2-4$3-a$4-"),
        "<num>": F.substring(F.translate(digits, "abcdef", "123456"), 1, 16), "<no>": F.pmod(i, F.lit(90)).cast("string"), "<b64>": F.base64(F.unhex(digits)),
        "<c32>": F.substring(clean64, 1, 32), "<c36>": F.substring(clean64, 1, 36), "<c60>": F.substring(clean64, 1, 60), "<C16>": F.upper(F.substring(clean64, 1, 16)),
        "<word>": glued("x", 2, LATIN), "<mot>": glued("z", 3, OTHER), "<long>": glued("q", 8, LATIN), "<lang>": glued("r", 7, OTHER), "<LANG>": F.upper(glued("r", 8, OTHER)),
    }

    def filled(shape: Column) -> Column:
        for mark, value in parts.items():
            shape = F.replace(shape, F.lit(mark), value)
        return shape

    # Values that look real in examples and tests are placeholders; most other findings stand in code, settings or logs.
    shown = pick("w", ["docs/example.md", "tests/fixtures/keys.json", "README.md", "samples/app.env", "test/test_login.py"])
    used = pick("v", ["src/app.py", "config/prod.env", "deploy/values.yaml", "logs/2024.log", ""])
    kind = F.pmod(F.xxhash64(i, F.lit("label")), F.lit(20)).cast("int")  # 0 to 9 real, 10 to 17 false, 18 and 19 real but for the path
    path = F.when(kind >= 18, shown).when((kind >= 10) & (F.pmod(F.xxhash64(i, F.lit("p")), F.lit(3)) == 0), shown).otherwise(used)
    return spark.range(n).select(filled(F.when((kind >= 10) & (kind < 18), pick("k", FALSE)).otherwise(pick("k", REAL))).alias("text"), path.alias("path"), (kind < 10).cast("int").alias("label"))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 5, seed: int = 1) -> list:
    """Trees of (feature, threshold, left, right) or a leaf's share of secrets, each from a bootstrap of the rows."""
    rng = np.random.default_rng(seed)
    width = max(2, int(np.ceil(np.sqrt(x.shape[1]))) + 1)

    def grow(rows: np.ndarray, left: int):
        share = float(y[rows].mean())
        if left == 0 or len(rows) < 2 * least or share in (0.0, 1.0):
            return share
        best = None
        for f in sorted(rng.choice(x.shape[1], width, replace=False).tolist()):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 15))):
                low = v <= t
                a, b = int(low.sum()), int((~low).sum())
                if min(a, b) < least:
                    continue
                p, q = y[rows[low]].mean(), y[rows[~low]].mean()
                cost = a * p * (1 - p) + b * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(t), low)
        if best is None:
            return share
        _, f, t, low = best
        return (f, t, grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return [grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def train(findings: DataFrame, most: int = 20_000, **how) -> list:
    """A forest from labelled findings (text, path, label); each text's candidates take its label.

    At most `most` candidates are learned from, in the order of a hash of them, so what comes to the driver is bounded
    however many rows there are or repeat. Rows with a null label or text teach nothing. Without any candidate the
    forest is one leaf of 0 and nothing is reported; with one label only it is that label.
    """
    rows = findings.filter("label is not null and text is not null").select("label", F.explode(candidates(F.col("text"), F.col("path"))).alias("c"))
    rows = rows.select(F.col("label").cast("double").alias("label"), *[F.col(f"c.f.{n}") for n in FEATURES])
    rows = sorted(tuple(r) for r in rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(most).collect())
    if not rows:
        return [0.0]
    data = np.asarray(rows, dtype=np.float64)
    return grow_forest(data[:, 1:], data[:, 0], **how)


def _depth(node) -> int:
    return 1 + max(_depth(node[2]), _depth(node[3])) if isinstance(node, tuple) else 0


def forest_score(forest: list, f: Column) -> Column:
    """The forest's mean vote as one SQL expression over a struct of features.

    All trees are complete ones of the same depth: node i of a tree has the children 2i and 2i + 1, and a leaf above the
    last level fills all places below it. The walk is `depth` steps in an `aggregate` over the trees' numbers.
    """
    depth = max(1, *map(_depth, forest))
    split, bound, leaf = [], [], []
    for tree in forest:
        level = [tree]
        nodes = [None]  # places count from 1
        for _ in range(depth):
            nodes += level
            level = [x for node in level for x in ((node[2], node[3]) if isinstance(node, tuple) else (node, node))]
        split += [node[0] if isinstance(node, tuple) else 0 for node in nodes]
        bound += [node[1] if isinstance(node, tuple) else 0.0 for node in nodes]
        leaf += [float(x) for x in level]
    literal = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")
    splits, bounds, leaves = literal(split, "int"), literal(bound, "double"), literal(leaf, "double")
    width = 1 << depth
    x = F.array(*[f[n] for n in FEATURES])

    def vote(x: Column, tree: Column) -> Column:
        step = lambda at, _: at * 2 + F.when(F.get(x, F.get(splits, tree * width + at)) <= F.get(bounds, tree * width + at), 0).otherwise(1)
        place = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)
        return F.get(leaves, tree * width + place - width)

    trees = F.sequence(F.lit(0), F.lit(len(forest) - 1))
    return let(x, lambda x: F.aggregate(trees, F.lit(0.0), lambda total, tree: total + vote(x, tree)) / float(len(forest)))


def _found(forest: list, text: Column, path: Column, least: float) -> Column:
    scored = F.transform(
        candidates(text, path),
        lambda c: F.struct(c["word_index"].alias("word_index"), c["value"].alias("value"), F.round(forest_score(forest, c["f"]), 6).alias("score")),
    )
    return F.filter(scored, lambda c: c["score"] >= least)


def scan(docs: DataFrame, forest: list, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", least: float = 0.5) -> DataFrame:
    """One row per finding: doc_id, word_index (from 0), n_chars, digest (sha-256 of the value) and score.

    Null and empty texts and empty tables have no findings. Findings of repeated rows repeat. The secret itself is not
    returned. Only id, text and path are read, so other columns can't clash; a null path counts as empty.
    """
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit("")
    found = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.explode(_found(forest, F.col(f"`{text_col}`").cast("string"), path, least)).alias("c")
    )
    return found.select(
        "doc_id", F.col("c.word_index").alias("word_index"), F.length("c.value").cast("long").alias("n_chars"),
        F.sha2(F.col("c.value"), 256).alias("digest"), F.col("c.score").alias("score"),
    )


def redact(docs: DataFrame, forest: list, text_col: str = "text", path_col: str | None = "source", least: float = 0.5, mask: str = MASK) -> DataFrame:
    """`docs` with every found secret replaced by `mask` wherever it stands in its text; rows and columns stay."""
    text = F.col(f"`{text_col}`")
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit("")
    clean = let(
        F.transform(_found(forest, text, path, least), lambda c: c["value"]),
        lambda found: F.when(F.size(found) > 0, F.aggregate(found, text, lambda a, v: F.replace(a, v, F.lit(mask)))).otherwise(text),
    )
    return docs.withColumn(text_col, F.coalesce(clean, text))
