"""Secret scan: pattern candidates, then a random forest that removes false positives; DataFrame functions and JVM code only.

Candidates are runs of LONG or more of [A-Za-z0-9+/_=-] with a digit, inside the pieces of a
text between white space; runs of SHORT or more, and runs without a digit, where an issuer's
prefix begins them or a cue word stands in the piece or the three before it.  Their features:
length, shares of character kinds, character transitions, distinct characters, entropy,
dictionary coverage, path shape, and cue words in the piece itself and its neighbours.  The
forest is trained from TRAIN_FINDINGS labelled findings, which a rule writes as DataFrame
expressions (a documented bound, the same at every corpus size).  A finding is reported with
its score; secret means score >= THRESHOLD.

Only hashes of candidates leave the operator.  One narrow pass over the documents.

Defined cases: null and empty texts have no candidates; repeated rows are scanned one by
one; a null doc_id is reported as null; a very long text is scanned whole, with 40 characters
of each neighbour beside a candidate; equal candidates are findings of their own; extra
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT, LONG = 8, 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORT},}}"
TRAIN_FINDINGS = 6000
TREES, DEPTH = 32, 8
THRESHOLD = 0.5

#: Words that speak for or against a secret nearby, common name parts, and issuers' prefixes.
CUES = "token|secret|passw|pwd|apikey|api_key|api-key|access|auth|bearer|credential|private|signing|client_key"
ANTI = "sha|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|integrity|build|order|card|isbn|example|sample|placeholder|your|dummy|test|image|http|www|href|src"
DICTIONARY = "the|and|ing|tion|ent|her|for|tha|with|this|from|main|java|test|user|data|file|page|name|type|list|index|config|module|version|image|value|class|string|report|project|source|build|static|assets|public|example|dummy|placeholder|your|here|insert|change|sample|lib|com|org|net|src|doc|html|json|www"
PREFIX_ANYWHERE = r"(?:^|[^A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|ghs_|sk-|sk_live|pk_live|xox[abp]-|AIza|eyJ|glpat-|SG\.)"
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|sk-|sk_live|pk_live|xox[abp]-|AIza|eyJ|glpat-|SG\.)"

FEATURES = (
    "n", "digits", "upper", "lower", "other", "runs", "distinct", "entropy", "covered", "hex", "all_digits", "uuid",
    "prefix", "slashes", "extension", "cue", "near_cue", "anti", "near_anti", "assigned", "quoted", "padded",
)


def _share(c: Column, chars: str) -> Column:
    return F.regexp_count(c, F.lit(f"[{chars}]")) / F.length(c)


def features(piece: Column, before: Column, after: Column, c: Column) -> list[Column]:
    """Feature columns of candidate c, found in piece, with the text of its neighbours."""
    n = F.length(c)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "_")
    chars = F.array_remove(F.array_distinct(F.split(c, "")), "")
    p = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda acc, x: acc - p(x) * F.log2(p(x)))
    covered = (n - F.length(F.regexp_replace(F.lower(c), DICTIONARY, ""))) / n
    own, near = F.lower(F.replace(piece, c, F.lit(" "))), F.lower(F.concat_ws(" ", before, after))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    made = {
        "n": F.least(n, F.lit(200)), "digits": _share(c, "0-9"), "upper": _share(c, "A-Z"), "lower": _share(c, "a-z"), "other": _share(c, "^A-Za-z0-9"),
        "runs": F.regexp_count(kinds, F.lit("0+|a+|A+|_+")) / n, "distinct": F.size(chars) / F.least(n, F.lit(64)), "entropy": entropy, "covered": covered,
        "hex": flag(c.rlike("^[0-9a-fA-F]+$")), "all_digits": flag(c.rlike("^[0-9=_+/-]+$")), "uuid": flag(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        "prefix": flag(c.rlike(PREFIX)), "slashes": F.regexp_count(c, F.lit("/")) / n, "extension": flag(own.rlike(r"^\S*\s\.[a-z]{1,5}\b")),
        "cue": flag(own.rlike(CUES)), "near_cue": flag(near.rlike(CUES)), "anti": flag(F.concat(own, F.lit(" "), F.lower(c)).rlike(ANTI)), "near_anti": flag(near.rlike(ANTI)),
        "assigned": flag(F.concat_ws(" ", before, own).rlike(r"[=:]\W*$")), "quoted": flag(piece.rlike("[\"'`]")), "padded": flag(c.endswith("=")),
    }
    return [F.coalesce(made[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece_no (0-based, between white space), piece, before, after, candidate, nth (in its piece).

    A piece takes the ends of its neighbours with it before pieces become rows, so a text is not repeated beside its candidates.
    """
    t = F.col(f"`{text}`")
    some = docs.filter(t.rlike(rf"[A-Za-z0-9+/_=-]{{{LONG},}}") | t.rlike(f"(?i)(?:{CUES})") | t.rlike(PREFIX_ANYWHERE))
    some = some.select(F.col(f"`{doc_id}`").alias("doc_id"), F.split(t, r"[\x20\x09-\x0D]+").alias("w"))
    near = lambda i, cut, *at: F.concat_ws(" ", *(cut(F.coalesce(F.get("w", i + k), F.lit(""))) for k in at))
    last, first = (lambda x: F.right(x, F.lit(40))), (lambda x: F.substring(x, 1, 40))
    hit = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("piece_no"), x.alias("piece"))), lambda x: x["piece"].rlike(CANDIDATE))
    hit = F.transform(hit, lambda h: F.struct(h["piece_no"].alias("piece_no"), h["piece"].alias("piece"), near(h["piece_no"], last, -3, -2, -1).alias("before"), near(h["piece_no"], first, 1, 2).alias("after")))
    flat = some.select("doc_id", F.explode(hit).alias("h")).select("doc_id", "h.*")
    cued = F.concat_ws(" ", "before", "piece").rlike(f"(?i)(?:{CUES})")
    flat = flat.withColumn("cued", cued).filter(F.col("cued") | F.col("piece").rlike(rf"[A-Za-z0-9+/_=-]{{{LONG},}}") | F.col("piece").rlike(PREFIX_ANYWHERE))
    flat = flat.select("*", F.posexplode(F.regexp_extract_all("piece", F.lit(f"({CANDIDATE})"))).alias("nth", "candidate"))
    plain = (F.length("candidate") >= LONG) & F.col("candidate").rlike("[0-9]")
    named = F.length(F.regexp_replace(F.lower("candidate"), f"{CUES}|key|client|api|[_=/+-]", "")) < 4  # the name of a secret, not its value
    return flat.filter((plain | F.col("cued") | F.col("candidate").rlike(PREFIX)) & ~named).drop("cued")


def labelled_findings(spark: SparkSession, n: int = TRAIN_FINDINGS, start: int = 0) -> DataFrame:
    """n findings, by ids from start, with label 1 for secrets: real shapes with telling words, and look-alikes."""
    def h(salt: str, bits: int = 256) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(salt), F.col("id").cast("string")), bits)

    def letters(salt: str, size: int) -> Column:
        return F.substring(F.regexp_replace(F.base64(F.unhex(h(salt, 512))), "[+/=]", ""), 1, size)

    def pick(salt: str, *xs: str) -> Column:
        return F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))

    word = lambda salt: pick(salt, "theion", "ander", "ofthe", "la", "mente", "reing", "der", "station", "that")
    cue = pick("cue", "token", "secret", "password", "api_key", "auth", "access_key", "client_secret", "private_key", "bearer")
    anti = pick("anti", "commit", "sha256", "md5", "checksum", "digest", "etag", "revision", "build")
    digits = lambda salt, size: F.substring(F.regexp_replace(F.concat(h(salt), h(salt + "'")), "[a-f]", ""), 1, size)
    value = F.array(
        # secrets
        F.substring(h("a"), 1, 40), F.substring(h("b"), 1, 32), letters("c", 40), F.concat(F.lit("AKIA"), F.upper(letters("d", 16))), F.concat(F.lit("ghp_"), letters("e", 36)),
        F.concat(F.lit("sk-"), letters("f", 44)), F.concat(letters("g", 20), F.lit("_"), letters("h", 10), F.lit("1")), F.concat(F.base64(F.unhex(h("i"))), F.lit("")),
        # look-alikes
        F.substring(h("j"), 1, 40), h("k"), F.concat_ws("-", F.substring(h("l"), 1, 8), F.substring(h("l"), 9, 4), F.substring(h("l"), 13, 4), F.substring(h("l"), 17, 4), F.substring(h("l"), 21, 12)),
        digits("m", 16), F.concat(F.lit("src/main/java/"), word("n"), F.lit("/"), word("o"), F.lit("Test1")), F.concat(F.lit("your-"), word("p"), F.lit("-placeholder-123")),
        F.concat(F.lit("2024-05-0"), F.substring(digits("q", 3), 1, 1), F.lit("_build-report-"), digits("r", 4)), F.concat(word("s"), word("t"), word("u"), word("v"), F.substring(digits("w", 4), 1, 1)),
        F.concat(F.lit("4"), digits("5", 15)), F.translate(digits("6", 19), "789", "012"),
        # words and names where a secret could stand
        pick("7", "required", "something", "undefined", "changeme-please", "documentation", "authentication", "expires_in", "your-password-here", "process-env", "settings", "description", "Required", "DATABASE_NAME"),
        F.concat(word("8"), word("9"), word("10")),
        # secrets without digits, and short ones
        F.translate(letters("11", 24), "0123456789", "qWeRtZuKpY"), F.concat(F.translate(letters("12", 6), "0123456789", "qWeRtZuKpY"), F.lit("7"), letters("13", 4)), F.concat(F.lit("AKIA"), F.translate(F.upper(letters("14", 16)), "0123456789", "QWERTZUKPY")),
    )
    kind = F.pmod(F.col("id"), F.lit(23)).cast("int")
    secret = (kind < 8) | (kind >= 20)
    # Half of the look-alikes that could be secrets by shape alone have no word near; the rest say what they are.
    form = pick("form", "= \"", "=", ": ", "= ", ":")
    bare = kind.isin(3, 4, 5, 22) & (F.pmod(F.xxhash64(F.lit("b"), "id"), F.lit(3)) == 0)  # an issuer's prefix says it alone
    told = (secret & ~bare) | (kind.isin(18, 19) & (F.pmod(F.xxhash64(F.lit("t"), "id"), F.lit(4)) != 0)) | (kind.isin(11, 16, 17) & (F.pmod(F.xxhash64(F.lit("z"), "id"), F.lit(3)) == 0))  # digits alone are none, whatever stands near
    lead = F.when(told, F.concat(cue, F.lit(" "), form)).when((F.pmod(F.xxhash64(F.lit("x"), "id"), F.lit(2)) == 0) & ~bare, F.concat(anti, F.lit(" "))).otherwise(F.concat(word("y"), F.lit(" ")))
    close = F.when(told & F.contains(lead, F.lit('"')), F.lit('" ')).otherwise(F.lit(" "))
    line = F.concat(word("1"), F.lit(" "), word("2"), F.lit(" "), lead, F.get(value, kind), close, word("3"), F.lit(" "), word("4"))
    return spark.range(start, start + n, 1, 4).select(F.col("id").alias("doc_id"), line.alias("text"), F.get(value, kind).alias("value"), secret.cast("double").alias("label"))


def train(spark: SparkSession) -> PipelineModel:
    lines = spark.createDataFrame(labelled_findings(spark).toArrow())  # bounded; the rule that wrote it stays out of later plans
    found = candidates(lines).join(lines.select("doc_id", "value", "label"), "doc_id").filter(F.contains("value", "candidate"))
    rows = found.select("label", *features(*map(F.col, ("piece", "before", "after", "candidate")))).orderBy("label", *FEATURES)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label", maxMemoryInMB=64)
    return PipelineModel([assembler, forest.fit(assembler.transform(rows.coalesce(1)))])


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: PipelineModel | None = None) -> DataFrame:
    """One row a candidate: doc_id, piece_no, nth, n_chars, sha256, score, secret."""
    found = candidates(docs, doc_id, text)
    rows = found.select("doc_id", "piece_no", "nth", F.sha2("candidate", 256).alias("sha256"), F.length("candidate").cast("long").alias("n_chars"), *features(*map(F.col, ("piece", "before", "after", "candidate"))))
    scored = (model or train(docs.sparkSession)).transform(rows)
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), F.col("nth").cast("long").alias("nth"), "n_chars", "sha256", score.alias("score"), (score >= THRESHOLD).alias("secret"))


def query(docs: DataFrame) -> DataFrame:
    return secret_scan(docs).filter("secret").drop("secret")
