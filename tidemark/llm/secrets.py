"""Operator 8, secret scans: candidates by pattern, false positives out by a random forest.

All of it is DataFrame functions and Spark ML: all runs of 16 or more characters
that hold a digit or are assigned to a secret's name are candidates, and so are
values of any length that are given to such a name, stand between user and host,
follow Bearer or fill a block of a private key. Features are a candidate's length, character transitions,
dictionary coverage, the path it comes from and the words around it; the forest
is trained from labelled findings. Findings are labelled by a small fixed list
and by rules strict enough to be sure of (a mixed value assigned to a secret's
name, a key of a known form, numbers only, placeholders, digests named so); what
no rule is sure of is left to the forest. Training takes at most MAX_FINDINGS
rows, a bound that does not grow.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read_table, stored

MAX_FINDINGS, TREES, DEPTH, LIMIT = 20_000, 20, 6, 0.5
BROADCAST_ROWS = 200_000  # documents with secrets that may be broadcast; beyond, Spark shuffles
MASK = "[SECRET]"
#: A web token is one run with its dots, so that its payload and signature go with its header.
CORE = r"eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+){1,4}|[A-Za-z0-9+/_-]{16,}={0,2}"
#: What a secret's name holds. `pass` and `pin` count as whole words only, `auth` not where an author is meant.
PASS_NAMES = r"(?<!by)(?<!com)(?<!sur)(?<!tres)pass(?:words?|wd|w|phrase|code|key)?(?![a-z])|pwd|(?<![a-z])pin(?![a-z])"
SECRET_NAMES = rf"token|secret|{PASS_NAMES}|api.?key|access.?key|private.?key|auth(?!ors?\b)|credential"
#: A name that holds one of these, of any length, and all that stands between it and its value. Each word is looked at once.
NAMED = rf"(?<![\w.-])(?:(?i:api|access|private)\s)?(?=[\w.-]*(?i:{SECRET_NAMES})|(?<=[\w]\s)(?i:key))[\w.-]++[\"'`]?\s*+[:=]>?\s*+(?:(?i:bearer|basic|token)\s++)?[\"'`]?"
#: A quoted value is all between its quotes; another one ends before a space, a quote, or a sign and the name of the next value.
VALUE = r"(?<=\")[^\"\n]+(?=\")|(?<=')[^'\n]+(?=')|(?<=`)[^`\n]+(?=`)|[^\s\"'`]+?(?=[.,;)\]}>]{0,4}(?:[\s\"'`]|$)|[,;&][\w.-]++[:=])"
#: What stands before a value of any length and alphabet, and the value: given to a name, between user and host, after Bearer, in a key block.
GIVEN = (
    rf"({NAMED})({VALUE})",
    r"((?<![\w.+-])[\w.+-]++:|//[^\s:/@\"'<>]*+:)([^\s/@\"'<>:]++(?::[^\s/@\"'<>:]++){0,3})@[\w\[]",
    r"((?i:\bbearer)\s++)([A-Za-z0-9._~+/-]+=*)",
    r"(-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s*+)([\s\S]+?)(?=\s*-----END)",
)
#: How keys of some public services begin, and words that name a digest or an id rather than a secret.
KNOWN_FORM = r"^(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_|glpat-|sk-(?:proj-)?[A-Za-z0-9]|sk_live_|xox[abprs]-|AKIA[0-9A-Z]{12,}|AIza[0-9A-Za-z_-]{20,}|npm_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{8,}\.|MII[A-Za-z0-9+/]{13,})"
DIGEST_NAMES = r"(?i)(?:commit|\bsha|md5|checksum|digest|revision|\bhash|uuid|guid|etag|integrity|\brev|object id|tree|blob)\S{0,12}\s*(?:is|of)?\s*[\"'`(]?$"
ASSIGNED = r"[=:]\s*[\"'`]?$"
#: What stands before a value that is between user and host, in a link's path, given without a space, or in a key block.
ADDRESS, LINK, TIGHT, BLOCK = r"//[^\s/@]*:$", r"(?i)\b(?:https?|ftp)://[^\s?=#]*$", r"[\w\"'`]=[\"'`]?$", r"PRIVATE KEY-----\s*$"
NAMES = rf"(?i)(?:{SECRET_NAMES}|auth|bearer)"
PLACEHOLDER = r"(?i)(example|sample|placeholder|changeme|dummy|your[-_]|x{6}|0{8}|1234567890|abcdefgh)"
PATHS = r"(?i)(test|example|sample|doc|spec|fixture|mock)"
#: Common words that secrets don't hold and identifiers do.
DICTIONARY = (
    "account", "access", "and", "api", "application", "auth", "before", "build", "cache", "class", "client", "code", "common", "config", "connection", "content",
    "context", "control", "count", "create", "data", "date", "default", "delete", "description", "document", "error", "event", "example", "factory", "field", "file", "filter",
    "first", "for", "format", "from", "function", "get", "group", "handler", "header", "image", "index", "info", "input", "item", "key", "label", "last", "length", "level",
    "list", "load", "local", "location", "manager", "map", "message", "method", "model", "module", "name", "node", "number", "object", "option", "order", "output", "page",
    "param", "parent", "password", "path", "process", "project", "property", "provider", "query", "read", "record", "request", "resource", "response", "result", "sample",
    "secret", "server", "service", "session", "set", "size", "source", "start", "state", "status", "string", "system", "table", "test", "text", "the", "time", "title", "token",
    "type", "update", "user", "value", "version", "view", "with", "word", "write",
)
#: Labelled findings (word before, word, word after, path, 1 = a secret).
FINDINGS = (
    ("token =", '"3f786850e387550fdab836ed7e6dc881de23001b"', "", "src/app", 1),
    ("secret:", "9b74c9897bac770ffc029102a200c5de", "", "conf/prod", 1),
    ("password =", "'Tq8vXw2LmZ4rKc7N'", "", "deploy", 1),
    ("api_key =", '"A7f3kQ9xP2mW8zR5tY1u"', "", "src/client", 1),
    ("export", "AUTH_TOKEN=b1946ac92492d2347c6235b4d2611184", "", "run", 1),
    ("Authorization: Bearer", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "", "notes", 1),
    ("the key", "d8e8fca2dc0f896fd7cb4cb0031ba249f1d2c3a4", "is", "mail", 1),
    ("and", "Zx9Kp4Qm7Ws2Rt6Yv3Bn8Lc1", "was", "mail", 1),
    ("card", "4111111111111111", "and", "mail", 0),
    ("number", "5500005555555559", ".", "mail", 0),
    ("call", "00442071838750123", "or", "mail", 0),
    ("token =", '"EXAMPLE0EXAMPLE0EXAMPLE0"', "", "docs/example", 0),
    ("password =", '"your-password-1234567890"', "", "docs", 0),
    ("class", "UserAccountServiceFactoryImpl2", "{", "src/app", 0),
    ("see", "docs/config/example_page_header_2", "for", "docs", 0),
    ("set", "default_session_timeout_value_30", "to", "conf", 0),
    ("api_key =", "xxxxxxxxxxxxxxxx1", "", "test", 0),
    ("version", "release-2024-01-31-build-20240131", "", "notes", 0),
    ("password =", "Tq8vXw2L!", "", "conf", 1),
    ("pwd:", "'m@ple$Rain.7'", "", "conf", 1),
    ("secret =", "kJhGfDsAqWe", "", "conf", 1),
    ("connect", "postgres://app:s3cr.pw@db.local/main", "", "conf", 1),
    ("Authorization: Bearer", "a8.Kd-2pQ", "", "notes", 1),
    ("password:", "required", "", "docs", 0),
    ("token:", "string", "", "docs", 0),
    ("auth =", "true", "", "conf", 0),
    ("the bearer", "of", "news", "mail", 0),
    ("write", "mailto:anna@mail.local", "", "mail", 0),
    ("password =", "os.environ", "", "src", 0),
    ("password =", '"correcthorsebatterystaple"', "", "conf", 1),
    ("secret =", "'swordfish'", "", "conf", 1),
    ('"pwd":', '"sunflower"', "", "conf", 1),
    ("passwd =", "letmein123", "", "conf", 1),
    ("password:", "hunter2", "", "notes", 1),
    ("deploy with", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "now", "notes", 1),
    ("the bot's", "xoxb-123456789012-abcdefABCDEF", "", "notes", 1),
    ("see commit", "3f786850e387550fdab836ed7e6dc881de23001b", "for", "mail", 0),
    ("the md5", "9b74c9897bac770ffc029102a200c5de", "matches", "mail", 0),
    ("uuid", "123e4567-e89b-12d3-a456-426614174000", "", "notes", 0),
    ("checksum:", "d8e8fca2dc0f896fd7cb4cb0031ba249f1d2c3a4", "", "notes", 0),
    ("export", "DB_PASS=Kx7pQ2mZ", "", "run", 1),
    ("export", "password=sunshine", "", "run", 1),
    ("pin:", "8472915", "", "notes", 1),
    ("use", "postgres://admin:hunter@db.example.com/x", "", "conf", 1),
    ("read", "https://site.org/a/AbCdEf12GhIjKl34MnOp", "", "mail", 0),
    ("password =", '"required"', "", "docs", 0),
    ("token =", "'string'", "", "docs", 0),
    ("secret =", '"none"', "", "conf", 0),
)
#: What is written where a secret would stand and is none.
NEUTRAL = ("required", "string", "none", "null", "true", "false", "optional", "hidden", "redacted", "undefined", "empty", "unknown", "default", "yes", "no")
FEATURES = ["length", "runs", "digits", "uppers", "distinct", "hex", "numeric", "coverage", "placeholder", "named", "assigned", "quoted", "followed", "test_path", "digest_name", "known_form", "neutral", "pass_named", "address", "link", "tight", "block"]


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Rows of docs with column __found: for each run of CORE in a word the run, what stands before it, the word and the word after.

    Text is split at white space only, so nothing is cut; null and empty texts
    have no candidates. All runs of a word are looked at, each with the run and
    the signs before it, the first with the two words before too. A run counts
    if it holds a digit, begins like a known key or is assigned to a secret's name.
    """
    words = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+")
    out = docs.withColumn("__words", words)
    hits = F.filter(
        F.transform("__words", lambda w, i: F.when((F.length(w) >= 16) & w.rlike(CORE), F.struct(i.alias("i"), w.alias("word"), F.regexp_extract_all(w, F.lit(CORE), 0).alias("runs"), F.split(w, CORE, -1).alias("gaps")))),
        lambda x: x.isNotNull(),
    )
    near = lambda i: F.coalesce(F.get(F.col("__words"), i), F.lit(""))
    runs = F.flatten(F.transform(hits, lambda h: F.transform(h["runs"], lambda run, k: F.struct(
        run.alias("core"),
        F.when(k == 0, F.concat_ws(" ", near(h["i"] - 2), near(h["i"] - 1), F.get(h["gaps"], F.lit(0)))).otherwise(F.concat(F.get(h["runs"], k - 1), F.get(h["gaps"], k))).alias("head"),
        F.when(F.size(h["runs"]) == 1, h["word"]).otherwise(F.concat(F.get(h["gaps"], k), run, F.get(h["gaps"], k + 1))).alias("word"),
        F.when(k == F.size(h["runs"]) - 1, near(h["i"] + 1)).otherwise("").alias("after"),
    ))))
    found = F.filter(runs, lambda r: r["core"].rlike("[0-9]") | r["core"].rlike(KNOWN_FORM) | (r["head"].rlike(NAMES) & r["head"].rlike(ASSIGNED)))
    found = F.concat(found, given(F.coalesce(F.col(text_col), F.lit(""))))
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    return out.withColumn("__found", found).withColumn("__path", path).drop("__words")


def given(text: Column) -> Column:
    """Values of GIVEN in text that aren't runs of CORE themselves, each once; the fields are those of candidates."""
    out = F.array().cast("array<struct<core:string,head:string,word:string,after:string>>")
    for pattern in GIVEN:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("head"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("core"))
        more = F.transform(pairs, lambda x: F.struct(x["core"].alias("core"), x["head"].alias("head"), F.concat(F.right(x["head"], F.lit(1)), x["core"]).alias("word"), F.lit("").alias("after")))
        out = F.concat(out, F.filter(more, lambda x: ~x["core"].rlike(f"^(?:{CORE})$")))
    return F.when(text.rlike("[:=]|(?i:bearer)|PRIVATE KEY"), F.array_distinct(out)).otherwise(F.array().cast("array<struct<core:string,head:string,word:string,after:string>>"))


def found_rows(texts: DataFrame, keys: list[str], path_col: str | None) -> DataFrame:
    """One row per candidate of texts(text): keys, core, head, word, after, path."""
    found = candidates(texts, "text", path_col)
    return found.select(*keys, F.explode("__found").alias("f"), F.col("__path").alias("path")).select(*keys, "f.*", "path")


def described(found: DataFrame) -> DataFrame:
    """found(core, head, word, after, path) with the forest's features."""
    core, word, head = F.col("core"), F.col("word"), F.col("head")
    size = F.length(core)
    share = lambda pattern: F.regexp_count(core, F.lit(pattern)) / size
    rest = F.regexp_replace(F.lower(core), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", "")
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return found.withColumns({
        "length": size.cast("double"),
        "runs": F.length(F.regexp_replace(core, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x")) / size,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(core, ""))) / size,
        "hex": flag(core.rlike("^[0-9a-fA-F]+$") & core.rlike("[a-fA-F]")), "numeric": flag(core.rlike("^[0-9+/_=-]+$")),
        "coverage": (size - F.length(rest)) / size, "placeholder": flag(core.rlike(PLACEHOLDER)),
        "named": flag(head.rlike(NAMES)), "assigned": flag(head.rlike(ASSIGNED)), "quoted": flag(word.rlike("[\"'`]")),
        "followed": flag(F.col("after").rlike("^[A-Za-z]+$")), "test_path": flag(F.col("path").rlike(PATHS)),
        "digest_name": flag(head.rlike(DIGEST_NAMES)), "pass_named": flag(head.rlike(rf"(?i)(?:{PASS_NAMES})")), "address": flag(head.rlike(ADDRESS)), "link": flag(head.rlike(LINK) & ~head.rlike(ADDRESS)), "tight": flag(head.rlike(TIGHT)), "block": flag(head.rlike(BLOCK)),
        "known_form": flag(core.rlike(KNOWN_FORM)), "neutral": flag(F.lower(F.regexp_replace(core, "[^A-Za-z]", "")).isin(*NEUTRAL)),
    })


def rule_label() -> Column:
    """1 or 0 where a rule is sure, else null."""
    is_ = lambda name: F.col(name) == 1
    given = is_("named") & is_("assigned") & ~is_("digest_name")
    # What is written between a user and a host, or after a password's name and = without a space, is one whatever it looks like.
    sure = is_("block") | is_("address") | (is_("pass_named") & is_("assigned") & (is_("tight") | is_("numeric")) & (F.col("length") >= 4))
    word = (F.col("length") < 16) & F.col("core").rlike("^[A-Za-z]?[a-z]*$") & ~(given & is_("quoted") & (F.col("length") >= 6))
    mixed = (F.col("length") < 16) & F.col("core").rlike("[a-z]+[A-Z]+[a-z]+[A-Z]") | F.col("core").rlike("[A-Za-z].*[!@#$%^&*?]")
    wrong = (is_("placeholder") | is_("neutral")) & ~is_("block") | ~sure & (is_("numeric") | (F.col("coverage") > 0.6) | word | (is_("link") & ~is_("known_form")) | (is_("digest_name") & (is_("hex") | F.col("core").rlike("^[0-9a-fA-F-]+$")) & ~is_("named")))
    right = sure | is_("known_form") | given & (F.col("coverage") < 0.3) & ((F.col("digits") > 0) | mixed | is_("quoted") & (F.col("length") >= 6))
    return F.when(wrong, 0.0).when(right, 1.0)


def train(spark: SparkSession, labelled: DataFrame | None = None) -> RandomForestClassificationModel:
    """The forest from FINDINGS and the labelled rows given (columns before, word, after, path, label), at most MAX_FINDINGS of them."""
    listed = [dict(zip(("before", "word", "after", "path", "label"), f, strict=True)) for f in FINDINGS]
    fixed = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(listed)), "array<struct<before:string,word:string,after:string,path:string,label:double>>")))
    texts = fixed.select(F.concat_ws(" ", "before", "word", F.when(F.col("after") != "", F.col("after"))).alias("text"), "path", "label")
    rows = described(found_rows(texts, ["label"], "path")).select("label", *FEATURES)
    if labelled is not None:
        more = labelled.select("label", *FEATURES).where("label is not null")
        rows = rows.unionByName(more.orderBy(F.xxhash64(*FEATURES)).limit(MAX_FINDINGS))
    rows = stored(rows.coalesce(1), "findings")
    data = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows)
    return RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt").fit(data)


def scored_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate of each row of docs: doc_id, text_key, core, score, secret."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([path_col] if path_col and path_col in docs.columns and path_col not in (id_col, text_col) else [])).withColumn("text_key", F.xxhash64("text"))
    rows = stored(described(found_rows(rows, ["doc_id", "text_key"], path_col)), "candidates")
    model = train(spark, rows.withColumn("label", rule_label()))
    scores = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows))
    score = vector_to_array("probability")[1]
    return scores.select("doc_id", "text_key", "core", score.alias("score"), (score >= LIMIT).alias("secret"))


def whole(value: Column) -> Column:
    """The pattern of value where it isn't part of a longer word."""
    return F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """docs with every secret in text_col replaced by MASK, plus n_candidates and n_secrets; these two replace columns of their names.

    A string found to be a secret once in a text is masked wherever the text
    has it, one that isn't a run of CORE only as a whole word. Null and empty texts stay as they are; repeated rows are all
    masked; rows without an id are matched by their text.
    """
    found = stored(scored_findings(docs, id_col, text_col, path_col), "scored")
    rows = docs.drop("n_candidates", "n_secrets")
    one, key, own = (free_name(rows, n) for n in ("row_id", "row_key", "row_secrets"))
    by_row = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n_candidates"), F.collect_set(F.when(F.col("secret"), F.col("core"))).alias(own))
    by_row = stored(by_row.select(F.col("doc_id").alias(one), F.col("text_key").alias(key), "n_candidates", own), "secrets")
    small = by_row.count() <= BROADCAST_ROWS
    same = F.col(id_col).eqNullSafe(F.col(one)) & (F.xxhash64(text_col) == F.col(key))
    out = rows.join(F.broadcast(by_row) if small else by_row, same, "left")
    # Longest first: a secret can hold another one.
    mine = F.coalesce(own, F.array().cast("array<string>"))
    order = lambda a, b: F.when(F.length(a) == F.length(b), F.when(a < b, -1).when(a > b, 1).otherwise(0)).otherwise(F.length(b) - F.length(a))
    hide = lambda t, s: F.when(s.rlike(f"^(?:{CORE})$"), F.replace(t, s, F.lit(MASK))).otherwise(F.regexp_replace(t, whole(s), F.lit(MASK)))
    masked = F.when(F.size(mine) == 0, F.col(text_col)).otherwise(F.aggregate(F.array_sort(mine, order), F.col(text_col), hide))
    out = out.withColumn(text_col, masked).withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)).cast("long"))
    return out.withColumn("n_secrets", F.size(mine).cast("long")).drop(one, key, own)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = redact(read_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_candidates", "n_secrets", F.length("text").cast("long").alias("redacted_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("redacted_sha256"))
