"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

The forest is fitted on labelled findings with length, character transitions, dictionary coverage, path likeness and
neighbouring words as features, and then applied as a column expression, so scanning needs no shuffle and no join.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that speak for a secret, words that speak against one, and words that names are made of.
FOR = "secret|token|api[_-]?key|passw(?:or)?d|passwd|pwd|private|credential|auth|bearer|access[_-]?key"
AGAINST = "commit|sha-?1|sha-?256|md5|checksum|digest|hash|uuid|guid|etag|revision|integrity|version|build|href|src|file|path|isbn|example|base64|image|sequence"
WORDS = "example sample test your here insert change dummy placeholder secret token password user name value config index main java class data file path http https www version release module package default number string object array method service client server key api id src lib com org net json html the and please required none null true false env environ get set self this function return".split()
#: A run of 16 characters or more, with the padding of base 64.
RUN = r"(?<![A-Za-z0-9+/_.\-])[A-Za-z0-9+/_.\-]{16,}+={0,2}"
#: What stands before a value that a word for secrets names, and such a value with it.
NAMED = r"(?i:" + FOR + r")[\w\-]*[\"']?\s{0,3}(?:=>|[:=])\s{0,3}"
VALUE = r"(?=[aAbBcCpPsStT])" + NAMED + r"(?:\"[^\"\n]{6,200}\"|'[^'\n]{6,200}'|[^\s\"',;]{6,200})"
PATTERN = f"{VALUE}|{RUN}"
#: Characters of the line before a candidate that are looked at.
BEFORE = 32
#: Words of the corpus that count as dictionary words: the most documents hold them.
DICTIONARY_WORDS = 2000
FEATURES = ("length", "switches", "distinct", "digits", "upper", "hex", "vowels", "symbols", "dictionary", "slashes", "dots", "speaks_for", "speaks_against", "assigned", "prefix")
TREES, DEPTH, SEED = 25, 8, 11
#: Labelled findings made for the fit.
LABELLED = 6000
MASK = "[SECRET]"


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS, text_col: str = "text") -> list[str]:
    """WORDS, and the words of three Latin letters or more that the most documents of docs hold; ties go to the first in order. All documents are counted."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.col(text_col)), "[^a-z]+"), lambda x: F.length(x) > 2))
    counts = docs.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return list(dict.fromkeys([*WORDS, *(r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect())]))


def features(left: Column, token: Column, known: list[str]) -> dict[str, Column]:
    """What the forest sees of a candidate; known: the dictionary."""
    low, n = F.lower(token), F.length(token).cast("double")
    share = lambda pattern, of=token: F.length(F.regexp_replace(of, pattern, "")) / n
    before = F.lower(left)
    parts = F.filter(F.regexp_extract_all(token, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), lambda x: F.lower(x).isin(*known))
    return {
        "length": F.least(n, F.lit(100.0)),
        "switches": F.size(F.split(F.regexp_replace(token, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x"), "")).cast("double") / n,
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / F.least(n, F.lit(40.0)),
        "digits": share("[^0-9]+"),
        "upper": share("[^A-Z]+"),
        "hex": share("[^0-9a-f]+", low),
        "vowels": share("[^aeiou]+", low),
        "symbols": share("[A-Za-z0-9]+"),
        "dictionary": F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x)) / n,
        "slashes": F.length(F.regexp_replace(token, "[^/]+", "")).cast("double"),
        "dots": F.length(F.regexp_replace(token, "[^.\\-]+", "")).cast("double"),
        "speaks_for": before.rlike(FOR).cast("double"),
        "speaks_against": before.rlike(AGAINST).cast("double"),
        "assigned": left.rlike("(?:[=:]|=>)\\s*[\"']?$").cast("double"),
        "prefix": token.rlike("^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_(?:live|test)_|AIza|eyJ|sk-)").cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """left, token, label: findings of some forty kinds made from the row number alone, two in five of them secrets."""
    i = F.col("id").cast("string")
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))
    hex40, hex64 = F.sha1(i), F.sha2(i, 256)
    b64 = F.regexp_replace(F.base64(F.unhex(hex64)), "=+$", "")
    uuid = F.regexp_replace(F.md5(i), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    names = pick(["token = \"", "secret: ", "api_key=", "apikey: '", "password = \"", "auth_token=", "Authorization: Bearer ", "access_key = ", "client_secret=\"", "private_token: "], "n")
    plain = pick(["the ", "in ", "see ", "and then ", "of "], "p")
    against = pick(["commit ", "sha256:", "checksum = ", "md5: ", "revision ", "build ", "etag=\"", "integrity=", "uuid: ", "version "], "a")
    word = pick(["example", "sample", "your", "test", "placeholder", "dummy"], "w")
    noun = pick(["ServiceClient", "configIndex", "moduleVersion", "PackageServer", "defaultObject", "stringArray"], "o")
    digits = lambda of, n: F.substring(F.regexp_replace(of, "[a-f]", ""), 1, n)
    letters = F.regexp_replace(b64, "[^A-Za-z]", "")
    mark = pick(["!", "@", "#", "$", "%", "^", "&", "*", "?", "~"], "m")
    filler = pick(["please", "required", "changeme", "<your-token>", "${SECRET_NAME}", "********", "xxxxxxxx", "os.environ", "getToken()", "function", "undefined", "process.env.KEY", "the-value", "string", "(hidden)"], "f")
    data = pick(["data:image/png;base64,", "base64: ", "image data ", "src=\"data:font/woff;base64,", "sequence "], "b")
    kinds = [
        (names, hex40, 1), (names, b64, 1), (names, F.substring(hex64, 1, 32), 1), (names, F.concat(F.substring(b64, 1, 20), F.substring(hex40, 1, 4)), 1), (names, F.substring(b64, 1, 12), 1),
        (names, F.concat(F.substring(letters, 1, 5), mark, digits(hex40, 3), mark, F.substring(letters, 6, 3)), 1), (names, F.concat(F.lower(F.substring(letters, 1, 7)), digits(hex40, 2)), 1), (names, F.concat(F.lower(noun), digits(hex40, 3), mark), 1),
        (names, F.concat(F.lower(word), digits(hex40, 1), F.lower(F.substring(letters, 1, 6)), digits(hex64, 2)), 1), (names, F.substring(letters, 1, 32), 1), (names, F.lower(F.substring(letters, 1, 24)), 1),
        (plain, F.concat(pick(["AKIA", "ASIA"], "k"), F.upper(F.substring(hex40, 1, 16))), 1), (plain, F.concat(pick(["ghp_", "gho_", "glpat-", "sk_live_", "AIza", "sk-"], "g"), F.substring(b64, 1, 36)), 1),
        (plain, F.concat(F.lit("xoxb-"), digits(hex64, 11), F.lit("-"), F.substring(b64, 1, 24)), 1), (plain, F.concat(F.lit("eyJhbGciOi"), F.substring(b64, 1, 20), F.lit("."), F.substring(b64, 5, 30)), 1),
        (against, hex40, 0), (against, hex64, 0), (F.concat(against, F.lit("id ")), uuid, 0), (plain, hex40, 0), (plain, hex64, 0), (plain, F.md5(i), 0), (plain, uuid, 0), (data, F.concat(b64, b64), 0), (data, F.concat(F.lit("iVBORw0KGgo"), b64), 0),
        (names, F.concat(word, F.lit("_api_key_"), word, F.lit("_123")), 0), (names, filler, 0), (names, filler, 0), (names, F.concat(word, F.lit("-"), word), 0), (names, F.concat(noun, F.lit("."), word, F.lit(".value1")), 0), (names, F.repeat(F.lit("x1"), 12), 0),
        (plain, F.concat(noun, F.lit("Method"), digits(hex40, 2)), 0), (plain, F.concat(noun, F.initcap(word), noun), 0), (plain, F.concat(F.lit("src/main/"), word, F.lit("/"), noun, F.lit("2.java")), 0), (plain, F.concat(F.lit("https-www."), word, F.lit(".com/path/v2/"), noun), 0),
        (plain, F.concat(F.lit("mail."), F.substring(F.regexp_replace(hex40, "[0-9]", ""), 1, 9), F.lit("-host7.example.com")), 0), (plain, F.concat(F.lit("20"), digits(hex40, 2), F.lit("-11-05T10.20.30-utc")), 0), (plain, F.concat(word, F.lit("_"), F.lower(noun), F.lit("_"), digits(hex40, 4)), 0),
    ]
    made = F.array(*(F.struct(a.alias("left"), b.alias("token"), F.lit(float(c)).alias("label")) for a, b, c in kinds))
    return spark.range(n).withColumn("f", F.element_at(made, (F.col("id") % len(kinds) + 1).cast("int"))).select("f.*")


def fit_forest(labelled: DataFrame, known: list[str], trees: int = TREES, depth: int = DEPTH) -> list:
    """Trees as (feature, threshold, tree at most, tree above), or a class; from left, token and label."""
    rows = labelled.coalesce(1).select("label", *(c.alias(n) for n, c in features(F.col("left"), F.col("token"), known).items()))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    text = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird").fit(vectors).toDebugString
    lines = iter([x.strip() for x in text.split("\n") if re.match(r"\s*(If|Else|Predict)", x)])

    def read(line: str):
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        f, cut = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line).groups()
        low = read(next(lines))
        next(lines)  # Else
        return int(f), float(cut), low, read(next(lines))

    return [read(line) for line in lines]


def forest_vote(forest: list, x: dict[str, Column]) -> Column:
    """The share of trees that vote for a secret."""

    def value(node) -> Column:
        return F.lit(node) if isinstance(node, float) else F.when(x[FEATURES[node[0]]] <= node[1], value(node[2])).otherwise(value(node[3]))

    return sum((value(t) for t in forest[1:]), value(forest[0])) / float(len(forest))


def scan(docs: DataFrame, forest: list, known: list[str], text_col: str = "text", from_vote: float = 0.5) -> DataFrame:
    """docs, n_candidates and findings: an array of (left, token, vote) in order of the text, without repeats.

    Candidates are values of six characters or more that a word for secrets names, and runs of 16 or more that hold a
    letter and a digit, or letters in both cases. A null text has no candidates. A finding is a candidate with at least
    from_vote of the votes. left: up to BEFORE characters before the candidate, from its line and after the candidate before it.
    Columns of docs with the names of the two new ones are replaced; put them into a struct to keep them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits, candidates = "__meshlark_hits", "__meshlark_candidates"
    rows = docs.withColumn(hits, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    between = F.when(F.size(hits) > 0, F.split(text, PATTERN))

    def candidate(hit: Column, left: Column) -> Column:
        name = F.regexp_extract(hit, f"^{NAMED}(?=.{{6}})", 0)
        value = F.btrim(F.substr(hit, F.length(name) + 1), F.lit("\"'"))
        before = F.element_at(F.split(F.right(F.concat(left, name), F.lit(BEFORE)), "\n"), -1)
        return F.struct(before.alias("left"), F.rtrim(value, F.lit(".")).alias("token"), (F.length(name) > 0).alias("named"))

    def open_to_judgement(c: Column) -> Column:
        run = (F.length(c["token"]) >= 16) & c["token"].rlike("[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|[a-z][A-Z].*[a-z][A-Z]")
        return F.when(c["named"], F.length(c["token"]) >= 6).otherwise(run)

    pairs = F.zip_with(hits, F.slice(between, 1, F.size(hits)), candidate)
    some = F.array_distinct(F.transform(F.filter(pairs, open_to_judgement), lambda c: F.struct(c["left"], c["token"])))
    rows = rows.withColumn(candidates, F.when(F.size(hits) > 0, some).otherwise(F.expr("array()").cast("array<struct<left string, token string>>")))

    def judged(c: Column) -> Column:
        seen = F.array(F.struct(*(v.alias(k) for k, v in features(c["left"], c["token"], known).items())))
        return F.transform(seen, lambda x: F.struct(c["left"].alias("left"), c["token"].alias("token"), forest_vote(forest, {k: x[k] for k in FEATURES}).alias("vote")))[0]

    found = F.filter(F.transform(candidates, judged), lambda x: x["vote"] >= from_vote)
    return rows.withColumn("n_candidates", F.size(candidates)).withColumn("findings", found).drop(hits, candidates)


def redacted(text: Column, findings: Column, mask: str = MASK) -> Column:
    """text with every occurrence of every finding masked; longer findings first, so that one within another leaves nothing behind."""
    order = F.array_sort(F.array_distinct(F.transform(findings, lambda x: F.struct((-F.length(x["token"])).alias("n"), x["token"].alias("token")))))
    return F.aggregate(order, text, lambda t, x: F.replace(t, x["token"], F.lit(mask)))
