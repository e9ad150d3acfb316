"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are values of any characters that are assigned to a name such as ``token`` or ``password``
(quoted, 8 characters or more, or up to the next blank), private keys in PEM form, web tokens of three
dotted parts, tokens of 16 characters or more that mix letters and digits, and such as begin
as known keys do. Each has features of its length, its character transitions, how much of it dictionary words
cover, the path it stands in and the words of its line next to it. The dictionary is learnt from the corpus: the
DICTIONARY_SIZE words of four letters or more that most documents hold. A random forest trained on labelled
findings tells secrets from other tokens. Candidate search, features and scoring are DataFrame
expressions and Spark's own forest; no Python runs on executors.

Training reads at most MAX_TRAINING labelled findings (chosen by hash, so reruns agree). The
tables hold no labelled findings; example_findings() makes them by rule, from hashes of
row numbers, for keys of common formats and for what scanners mistake for keys.

Defined cases: null or empty texts have no candidates. Very long texts are searched whole; what stands next to a
candidate reaches to its line's ends or the next candidate. Each occurrence is a finding, in the order of the text; repeated rows
give repeated findings. A null path counts as an empty one. Columns but doc_id, text and the path's aren't read,
whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import written

MAX_TRAINING = 20_000
THRESHOLD = 0.5
DICTIONARY_SIZE = 1000
#: Labelled words that example findings are made of: so many of the dictionary.
EXAMPLE_WORDS = 120

KEYWORDS = r"token|secret|passw(?:or)?d|pwd|passphrase|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key|client[_-]?secret"
# Words next to tokens that are no secrets, and common words in identifiers.
HARMLESS = "commit|sha|sha1|sha256|md5|hash|checksum|digest|etag|uuid|guid|revision|isbn|doi|version|build|example|placeholder|sample|dummy|fixture|test|id|ref|blob|tree|parent|integrity"
DICTIONARY = (
    "the and for with this that from your have not are was you all can value name user data test example sample dummy change default password secret token "
    "key account service client server config index table image button header footer content page file path function return class string number object error "
    "message request response license apache public version general info http https www com org net lorem ipsum hello world abc xyz foo bar baz placeholder insert here"
).split()
# A value that is given to such a name: NAME=, "name": ', name => and so on; the name's part first.
NAME = rf"(?<![\w-])[\w.-]{{0,40}}?(?i:{KEYWORDS})[\w.-]{{0,30}}[\"'\])]{{0,2}}\s{{0,3}}(?::=|=>|==?|:)\s{{0,3}}"
VALUE = r"(?:\"[^\"\n]{8,}\"|'[^'\n]{8,}'|`[^`\n]{8,}`|[^\s\"'`,;&<>(){}\[\]]{7,}[^\s\"'`,;&<>(){}\[\].:!?])"
PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----"
WEB_TOKEN = r"(?<![\w-])eyJ[\w-]{8,}\.[\w-]{8,}(?:\.[\w-]{8,})?"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])"
CANDIDATE = f"{NAME}{VALUE}|{PEM}|{WEB_TOKEN}|{TOKEN}"
#: The end of a text before a value that is given to such a name in another way: <name>, Bearer, --name.
NAMED = rf"(?i)(?:(?:{KEYWORDS})[\w.-]{{0,30}}[\"'\])]{{0,2}}\s*(?::=|=>|==?|:|>)\s*[\"'`]?|(?:bearer|basic|-(?:{KEYWORDS}))\s+[\"']?)$"
PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live|sk-|glpat-|AIza|eyJ|-----BEGIN)"
#: Values that stand for a secret that is somewhere else.
REFERENCE = r"(?i)^(?:\$\{|\$\(|\{\{|<|%\w+%$|\$[a-z_]+$)|environ|getenv|process\.env|secrets?\.|config\.|vault:|^x{4,}|\*{4,}|your[_-]|change[_-]?me|example|placeholder"
FEATURES = (
    "length transition_rate class_count digit_share upper_share hex_only vowel_share longest_letters dictionary_share "
    "after_keyword assigned quoted harmless_near path_test path_like known_prefix distinct_share special_share reference blanks"
).split()


def mixed(token: Column) -> Column:
    """Letters and digits: plain words and plain numbers are candidates only by their name or prefix."""
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def learn_dictionary(documents: DataFrame, size: int = DICTIONARY_SIZE) -> list[str]:
    """The words of 4 to 15 letters that most documents hold, and the fixed ones; ties by the word. ``size`` bounds what the driver takes."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![A-Za-z])[a-z]{4,15}(?![A-Za-z])"), F.lit(0)))
    counts = documents.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]
    return list(dict.fromkeys([*DICTIONARY, *found]))


def findings(documents: DataFrame, path_col: str = "source") -> DataFrame:
    """One row per candidate: doc_id, path, at (ordinal in the document), before, candidate, after."""
    path = F.coalesce(F.col("`" + path_col.replace("`", "``") + "`").cast("string"), F.lit(""))
    rows = documents.select("doc_id", path.alias("path"), "text").filter(F.col("text").rlike(CANDIDATE))
    tokens = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    between = F.split("text", CANDIDATE, -1)
    # a long name is a token itself, so what stands before a token takes in the token before it
    near = lambda i: F.concat(F.coalesce(F.get("tokens", i - 2), F.lit("")), F.element_at("between", i))

    def parts(i: Column) -> Column:
        match = F.element_at("tokens", i)
        name = F.when(match.rlike(rf"\A{NAME}{VALUE}\z"), F.regexp_extract(match, rf"\A{NAME}[\"'`]?", 0)).otherwise("")
        quote = F.regexp_extract(name, "[\"'`]$", 0)
        n = F.length(name)
        return F.struct(
            i.alias("at"),
            F.substr(match, n + 1, F.length(match) - n - F.length(quote)).alias("candidate"),
            F.concat(F.substring_index(near(i), "\n", -1), name).alias("before"),
            F.concat(quote, F.substring_index(F.element_at("between", i + 1), "\n", 1)).alias("after"),
        )

    rows = rows.select("doc_id", "path", tokens.alias("tokens"), between.alias("between"))
    placed = F.transform(F.sequence(F.lit(1), F.size("tokens")), parts)
    found = F.filter(placed, lambda x: mixed(x["candidate"]) | x["candidate"].rlike(PREFIX) | x["before"].rlike(NAMED))
    return rows.select("doc_id", "path", F.explode(found).alias("f")).select("doc_id", "path", "f.at", "f.before", "f.candidate", "f.after")


def with_features(rows: DataFrame, dictionary: list[str] = DICTIONARY) -> DataFrame:
    c, before, after, path = (F.col(x) for x in ("candidate", "before", "after", "path"))
    size = F.length(c).cast("double")
    share = lambda pattern: (size - F.length(F.regexp_replace(c, pattern, ""))) / size
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "$1"))
    words = F.regexp_replace(F.lower(c), "(?:" + "|".join(sorted((w for w in dictionary if len(w) > 2), key=len, reverse=True)) + ")", "")
    yes = lambda condition: condition.cast("double")
    features = {
        "length": size,
        "transition_rate": (runs - 1) / F.greatest(size - 1, F.lit(1.0)),
        "class_count": F.length(F.concat(*[F.when(classes.contains(x), x).otherwise("") for x in "aA0-"])).cast("double"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "hex_only": yes(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "vowel_share": share("[aeiouAEIOU]"),
        "longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda x: F.length(x))).cast("double"),
        "dictionary_share": (size - F.length(words)) / size,
        "after_keyword": yes(before.rlike(rf"(?i)(?:{KEYWORDS})\W{{0,6}}$") | before.rlike(NAMED)),
        "assigned": yes(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": yes(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "harmless_near": yes(before.rlike(rf"(?i)(?<![a-z])(?:{HARMLESS})\W{{0,6}}$")),
        "path_test": yes(path.rlike(r"(?i)(?:^|[/._-])(?:tests?|examples?|docs?|fixtures?|samples?)(?:$|[/._-])")),
        "path_like": yes(c.rlike("/[a-z]+/|^[a-z]+(?:[/_-][a-z0-9]+)+$") | before.rlike(r"(?:://|\./|@)\S*$")),
        "known_prefix": yes(c.rlike(PREFIX)),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / size,
        "special_share": share("[^A-Za-z0-9]"),
        "reference": yes(c.rlike(REFERENCE)),
        "blanks": share(r"\s"),
    }
    return rows.select("*", *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in features.items()])


def example_findings(spark: SparkSession, n: int = 8000, dictionary: list[str] = DICTIONARY) -> DataFrame:
    """Labelled findings by rule: before, candidate, after, path, label (1 secret, 0 not)."""
    vocabulary = [w for w in dictionary if len(w) > 2][:EXAMPLE_WORDS]
    rows = spark.range(n).select(
        "id",
        F.sha2(F.col("id").cast("string"), 256).alias("h"),
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256))), "[+/=]", "x").alias("b"),
        F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(18)).alias("kind"),
        F.pmod(F.xxhash64(F.lit("style"), "id"), F.lit(6)).alias("style"),
    )
    pick = lambda values, seed: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(values))) + 1).cast("int"))
    words = [pick(vocabulary, f"w{i}") for i in range(5)]
    name = pick(["token", "secret", "password", "api_key", "apikey", "access_key", "auth", "TOKEN", "client_secret", "Authorization: Bearer", "pwd"], "name")
    assign = pick([' = "', "=", ": ", ": '", ' := "', "='"], "assign")
    quiet = pick(["commit ", "sha256:", "md5 = ", "checksum: ", "etag: \"", "uuid=", "revision ", "build ", "see ", "the file ", "blob ", "integrity=\"", "id: "], "quiet")
    filler = F.concat_ws(" ", words[0], words[1], F.lit(""))
    hexes = F.substring(F.col("h"), 1, pick([32, 40, 64], "hexlen").cast("int"))
    random = F.substring("b", 1, pick([20, 24, 32, 40], "b64len").cast("int"))
    prefixed = F.concat(pick(["AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"], "prefix"), F.substring("b", 1, 28))
    ident = F.concat_ws("_", *words[:4], F.substring("h", 1, 2))
    path = F.concat_ws("/", *words[:3], F.concat(words[3], F.lit("2")))
    dummy = F.concat(pick(["example", "changeme", "your_token_here_", "placeholder", "xxxxxxxxxxxxxxxx", "test_password_"], "dummy"), words[4], F.lit("12345678"))
    uuid = F.regexp_replace(F.substring("h", 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    special = F.concat(F.substring("b", 1, pick([3, 4, 6], "s1").cast("int")), pick(["!", "@", "#", "$%", "&*", "?", "^"], "sp"), words[0], F.substring("b", 9, 3), pick(["!", "#1", "$", "@9", "%%"], "sp2"))
    phrase = F.concat(*words[:3], F.when(F.col("style") < 3, F.lit("")).otherwise(words[3]))
    web = F.concat(F.lit("eyJ"), F.substring("b", 1, 18), F.lit("."), F.substring("h", 1, 40), F.lit("."), F.substring("b", 20, 20))
    letters = F.translate(F.substring("b", 1, pick([16, 20, 24], "letters").cast("int")), "0123456789", "qXvTzRkWmB")
    reference = pick(["${SECRET_TOKEN}", "<your-token-here>", "os.environ['KEY']", "{{ vault.key }}", "process.env.TOKEN", "********", "changeme", "getenv(NAME)", "config.secret.value"], "ref")
    joint = pick([" ", "_", "-", " is "], "joint")
    prose = F.concat(words[0], joint, words[1], F.when(F.col("style") < 3, F.concat(joint, words[2])).otherwise(""))
    kind = F.col("kind")
    secret = (kind < 6) | kind.isin(12, 13, 14, 15)
    candidate = (
        F.when(kind <= 2, F.when(F.col("style") == 0, F.upper(hexes)).otherwise(hexes)).when(kind <= 4, random).when(kind == 5, prefixed)
        .when(kind <= 7, hexes).when(kind == 8, uuid).when(kind == 9, F.concat(ident, F.lit("0"))).when(kind == 10, path).when(kind == 11, dummy)
        .when(kind == 12, special).when(kind == 13, phrase).when(kind == 14, web).when(kind == 15, letters).when(kind == 16, reference).otherwise(prose)
    )
    named = F.concat(filler, name, assign)
    before = F.when(kind.isin(5, 14), F.concat(filler, F.when(F.col("style") < 3, F.concat(name, assign)).otherwise(F.lit("")))).when(secret | kind.isin(11, 16, 17), named)
    before = before.when(kind >= 9, F.concat(filler, F.when(F.col("style") < 2, F.lit("= ")).otherwise(F.lit("")))).otherwise(F.concat(filler, quiet))
    quote = F.regexp_extract(before, "[\"']$", 0)
    where = F.when(secret, pick(["config/app.yml", "src/main.py", ".env", "src0", "deploy/prod.json"], "path")).otherwise(pick(["tests/test_api.py", "docs/readme.md", "package-lock.json", "src0", "examples/demo.py"], "path"))
    return rows.select("id", before.alias("before"), candidate.alias("candidate"), F.concat(quote, F.lit(" "), words[4]).alias("after"), where.alias("path"), secret.cast("int").alias("label"))


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING, trees: int = 32, depth: int = 9, dictionary: list[str] = DICTIONARY) -> PipelineModel:
    """A forest from labelled findings (before, candidate, after, path, label)."""
    chosen = labelled.orderBy(F.xxhash64("before", "candidate", "after", "path")).limit(max_rows)  # the bound on training rows
    rows = written(with_features(chosen, dictionary).select(*FEATURES, F.col("label").cast("double").alias("label")), "training")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def scan(documents: DataFrame, model: PipelineModel, path_col: str = "source", threshold: float = THRESHOLD, dictionary: list[str] = DICTIONARY) -> DataFrame:
    """Every candidate with its probability and verdict: doc_id, path, at, before, candidate, after, probability, is_secret."""
    scored = model.transform(with_features(findings(documents, path_col), dictionary))
    probability = vector_to_array("probability")[1]
    return scored.select("doc_id", "path", "at", "before", "candidate", "after", probability.alias("probability"), (probability >= threshold).alias("is_secret"))
