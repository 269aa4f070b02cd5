"""Secret scan: candidates by shape, false positives removed by a random forest trained on labelled findings.

Candidates inside one word of the text are (1) every run of at least ``MIN_CHARS`` key characters that has a digit, both cases, a known
prefix or a key word beside it, (2) every value of 4 or more characters assigned to a name with a key word in it, unless the value is
such a run, (3) such a value with a digit after a verb ("the password is ..."), and (4) the password of a URL's user. A value of (2) may
hold a run of (1): both are rows. A quoted value of (2) may have spaces and ends with its quote, on its line; it counts as one word. The forest sees length, character transitions (the mean log-odds of its
pairs of neighbouring characters, and how often the class of character changes), how much of it dictionary words cover, the path it
comes from and the neighbouring words.
The labelled findings are generated (``labelled_findings``, a bounded number of rows): formats of live keys against digests, ids, hosts,
versions, names in code and placeholders, where most surroundings, those with key words too, belong to both labels. The log-odds
of transitions are fitted on one half of the findings and the forest on the other, so it does not trust them more than they deserve.

Only DataFrame functions and the JVM's forest; no shuffle but for the findings' own keys when texts are redacted.

Edge cases: null or empty text has no candidates; candidates of a very long text are rows; repeated rows give repeated findings and are redacted alike;
a null path or neighbour counts as empty; an empty table gives an empty result; other columns stay out, and pass through when texts are redacted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, fresh, materialise, swapped

MIN_CHARS = 16
SHAPE = "[A-Za-z0-9+/_.\\-]{16,}={0,2}"
#: The end of a gap that names what the next run is assigned to.
NAMED = "[A-Za-z_][A-Za-z0-9_.\\-]*[\"'`\\]]*[=:]+[\"'`(\\[]*$"
#: Up to this many redacted documents their secrets are broadcast (about 100 bytes each); beyond, the join is shuffled.
MAX_BROADCAST_DOCS = 50_000
#: Words that stand beside keys, and words that stand beside what only looks like one.
KEY_WORDS = "token|secret|passw|pwd|api.?key|access.?key|private.?key|[a-z0-9][_-]key|auth|bearer|credential|signing|passphrase|kennwort|contrase.a|(?<![a-z])(?:passe|clave|cookie|keys?)(?![a-z])|session.?id"
OTHER_WORDS = "sha|md5|checksum|commit|digest|hash|uuid|guid|version|revision|isbn|phone|mail|file|image|host|order|etag|example|(?<![a-z])ids?(?![a-z])"
#: Common words of code and of four languages, four letters or more.
DICTIONARY = (
    "about abstract access account action after agent alle also application async auth author avec base batch been before body boolean buffer build "
    "cache call change char check class client code column comme config connection constant container content context control copy count create current "
    "data default delete description dict directory display document down driver each edit element encode entry error event every example exception "
    "export external factory false field file final find first float folder form found from function general global good group handle handler have "
    "header hello here high host html http image import index info init input instance integer internal into item json just keep kind language level "
    "library like line link list load local long loop main make manager many message method mode model module more most name network next nicht node "
    "none null number object only open option order other output page parameter parse part password path pattern person place plugin point policy post "
    "print private process profile project provider public query read record remote report request reset resource response result return right role "
    "root schema search section send server service session setting some source start state static status storage string system table task template "
    "test text that their them there this time title tool total true type under update user value version view what when where which with work world your"
).split()
TEST_PATHS = "(?i)test|example|sample|fixture|mock|docs?/"
#: Beginnings of keys of known services.
PREFIX = "^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|[sr]k_live_|sk-|xox[abprs]-|AIza|eyJ|npm_|SG\\.)"
#: A name with a key word, and what may stand between it and its value; bounded, as they are looked behind.
NAME = f"(?:{KEY_WORDS})[A-Za-z0-9_.\\-]{{0,40}}[\"'`\\])\\\\]{{0,3}}"
SIGN = "(?:=>|:=|={1,3}|:)"
OPEN = "[\"'`(\\[\\\\]{0,3}"
#: An assigned value: up to the quote if one opens it, else up to a delimiter; "&" ends it only before another assignment.
_PLAIN = "\\s\"'`,;&<>(){}\\[\\]"
_INNER = f"(?:[^{_PLAIN}]|&(?![A-Za-z0-9_.\\-]{{1,60}}=))"
#: Verbs that assign in the four languages.
VERBS = ("is", "ist", "lautet", "est", "es")
USER = "://[A-Za-z0-9._%+\\-]{1,60}:"
VALUE = (
    f"(?i)(?<={NAME} ?{SIGN} ?{OPEN})(?:(?<=[\"'`])[^\"'`\\s]{{4,}}(?<!\\\\)|(?<![\"'`])[^{_PLAIN}=:\\\\]{_INNER}{{3,}})"
    f"|(?<={NAME} (?:{'|'.join(VERBS)}):? {OPEN})(?=[^\\s]*[0-9])[^{_PLAIN}=:\\\\]{_INNER}{{3,}}"
    f"|(?<={USER})[^\\s/@\"'`]{{4,}}(?=@)"
)
#: The end of the words before that is a name, with its sign or before it.
PENDING = f"(?i){NAME}(?: ?(?:{SIGN}{OPEN})?| (?:{'|'.join(VERBS)}):?)$"
#: A space inside a quoted value of a name with a key word, and what stands for it in the value's word.
INSIDE = f"(?i)((?:[\"'`](?<={NAME} ?{SIGN} ?[\"'`])(?=[^\"'`\\n]*[\"'`])|\\G(?!^))[^\"'`\\s]*) "
MARK = "\ue000"
FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_symbols", "f_prefix", "f_distinct", "f_runs", "f_vowels", "f_hex", "f_alpha_runs",
    "f_transition", "f_dictionary", "f_path", "f_key_near", "f_other_near", "f_assigned", "f_quoted", "f_blanks",
]
#: Letters, digits as one and all else as one.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0-"
_MODELS: dict[tuple[str, int, int], tuple[RandomForestClassificationModel, str]] = {}


def transitions(core: Column) -> Column:
    """The numbers of the pairs of neighbouring symbols; one pass over the characters, however many."""
    symbols = F.regexp_replace(F.regexp_replace(F.lower(core), "[0-9]", "0"), "[^a-z0]", "-")
    at = F.transform(F.regexp_extract_all(symbols, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    return F.transform(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, i: a * len(SYMBOLS) + F.get(at, i + 1))


def features(core: Column, before: Column, after: Column, path: Column, pairs: Column, log_odds: str) -> dict[str, Column]:
    """``pairs``: transitions(core). ``log_odds``: a number for each pair of symbols, in one string."""
    n = F.greatest(F.length(core), F.lit(1)).cast("double")
    low, context = F.lower(core), F.lower(F.concat_ws(" ", before, after))
    share = lambda chars: F.length(F.regexp_replace(core, f"[^{chars}]", "")) / n
    odds = F.split(F.lit(log_odds), " ").cast("array<double>")
    spelled = F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    return {
        "f_length": n,
        "f_digits": share("0-9"),
        "f_upper": share("A-Z"),
        "f_lower": share("a-z"),
        "f_other": share("+/_.=\\-"),
        "f_symbols": F.length(F.regexp_replace(core, "[A-Za-z0-9+/_.=\\-]", "")) / n,
        "f_prefix": core.rlike(PREFIX).cast("double"),
        "f_distinct": F.size(F.array_distinct(F.split(core, ""))) / n,
        "f_runs": F.length(runs) / n,
        "f_vowels": share("aeiouAEIOU"),
        "f_hex": core.rlike("^[0-9a-f]+$").cast("double"),
        "f_alpha_runs": (n - F.length(F.regexp_replace(core, "[A-Za-z]{5,}", ""))) / n,
        "f_transition": F.aggregate(pairs, F.lit(0.0), lambda x, p: x + F.get(odds, p.cast("int"))) / F.greatest(F.size(pairs), F.lit(1)),
        "f_dictionary": (n - F.length(spelled)) / n,
        "f_path": F.coalesce(path, F.lit("")).rlike(TEST_PATHS).cast("double"),
        "f_key_near": (context.rlike(KEY_WORDS) | F.coalesce(before, F.lit("")).rlike(f"{USER}$")).cast("double"),
        "f_other_near": context.rlike(OTHER_WORDS).cast("double"),
        "f_assigned": F.coalesce(before, F.lit("")).rlike("[=:]\\s*[\"'`(]*$").cast("double"),
        "f_quoted": F.coalesce(before, F.lit("")).rlike("[\"'`]$").cast("double"),
        "f_blanks": share(" "),
    }


def labelled_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """id, core, before, after, path, label: ``rows`` generated findings, the same on every run."""
    i = F.col("id")
    sha = F.sha2(i.cast("string").cast("binary"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(sha)), "=", "")
    pick = lambda salt, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    key = pick(1, ["token", "secret", "password", "api_key", "access_key", "auth token", "client_secret", "private key", "credential", "passwd", "first_key", "signing_key", "session_id", "access_key_id", "Kennwort", "clave", "contraseña", "mot de passe", "cookie", "key"])
    sign = pick(2, [" = \"", "=\"", ": '", "=", ": ", " = ", " := \"", " \""])
    note = pick(3, ["commit", "sha1", "md5", "checksum", "sha256:", "digest", "etag:", "revision", "image", "file hash", "order", "uuid", "guid ="])
    word = pick(4, ["the", "and", "of", "see", "der", "que", "le", "un", "on", "with", "is", "a"])
    digits = F.regexp_replace(F.conv(F.substring(sha, 1, 15), 16, 10), "^", "4")
    uuid = F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.substring(sha, 13, 4), F.substring(sha, 17, 4), F.substring(sha, 21, 12))
    hexes = F.expr("substring(sha2(cast(cast(id as string) as binary), 256), 1, element_at(array(32, 40, 40, 64, 24), cast(pmod(id, 5) as int) + 1))")
    live = F.concat(word, F.lit(" "), key, sign)
    noted = F.concat(word, F.lit(" "), note, F.lit(" "))
    plain = F.concat(word, F.lit(" "), word, F.lit(" "))
    letters = F.translate(b64, "0123456789+/", "gHkQzWvBxJyR")
    lower = F.translate(sha, "0123456789", "ghijklmnop")
    cut = lambda c, salt, least, most: F.substring(c, F.lit(1), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(most - least + 1)) + least).cast("int"))
    quoted = F.concat(word, F.lit(" "), key, pick(9, [" = \"", "=\"", ": '", " := \"", "\":\"", "\": \""]))
    bare = F.concat(word, F.lit(" "), key, pick(10, ["=", ": ", " = "]))
    either = F.when(F.pmod(F.xxhash64(i, F.lit(11)), F.lit(2)) == 0, quoted).otherwise(bare)
    anywhere = F.element_at(F.array(live, either, noted, plain), (F.pmod(F.xxhash64(i, F.lit(42)), F.lit(4)) + 1).cast("int"))
    parts = ["account", "service", "get", "client", "manager", "handler", "request", "session", "config", "access", "user", "provider", "factory", "remote", "context", "string", "bundes", "kraft", "wirtschaft", "gesellschaft", "schaftlich", "internal", "connection", "response", "storage", "header", "smith", "martin", "system", "reset", "holder", "garden", "maison", "tiempo", "freund", "bericht"]
    one, two, three = pick(12, parts), pick(13, parts), pick(14, parts)
    camel = F.concat(one, F.initcap(two), F.initcap(three), pick(15, ["Handler", "Factory", "Exception", "Controller"]))
    compound = F.concat(F.initcap(one), two, three, pick(15, ["ung", "schaft", "heit", "keit"]))
    snake = F.concat_ws("_", one, two, three, pick(16, ["key", "id", "secret", "token", "name", "value"]))
    weak = F.concat(pick(17, ["Tr0ub4dor", "Summer", "hunter", "Winter", "dragon", "M0nkey", "admin", "letmein", "Pa55w0rd", "qwerty"]), cut(digits, 18, 1, 4), pick(19, ["", "!", "&3", "#", "$x", "@1", "secret9"]))
    akia = F.concat(pick(43, ["AKIA", "ASIA"]), F.upper(F.substring(sha, 1, 16)))
    domain = F.concat(one, pick(40, [".", "-", "2.", "7."]), two, pick(41, [".com", ".org", ".net", ".io", ".de", ".fr"]))
    where = F.concat_ws("/", one, two, F.concat(three, F.substring(digits, 2, 3)))
    user = F.concat(word, F.lit(" "), pick(61, ["postgres", "mysql", "amqp", "https", "redis", "mongodb"]), F.lit("://"), pick(62, ["admin", "root", "app", "mailer", "ci"]), F.lit(":"))
    told = F.concat(word, F.lit(" "), key, F.lit(" "), pick(63, list(VERBS)), F.lit(" "))
    header = F.concat(word, F.lit(" "), pick(64, ["x-api-key", "api key", "access token", "auth-token", "client_secret", "secret key"]), sign)
    keyed = F.concat(word, F.lit(" key "))
    numbered = F.concat(word, pick(65, [" document id ", " page id ", " id: ", " node id=", " build id ", " object ids "]))
    things = [pick(k, ["kettle", "river", "stone", "candle", "ocean", "tiger", "lemon", "marble", "cloud", "pepper", "anchor", "velvet"]) for k in (66, 67, 68)]
    phrase = F.concat_ws(" ", things[0], F.when(i % 2 == 0, F.concat(F.substring(digits, 2, 2), things[1])).otherwise(F.concat_ws(" ", F.substring(digits, 2, 1), things[1])), things[2])
    said = F.concat_ws(" ", *[pick(k, DICTIONARY) for k in (69, 70, 71)], pick(72, ["here", "again", "please", "first", "or null", "of the page"]))
    named = F.concat_ws(" ", pick(73, ["Anna", "John", "Marie", "Karl", "Lucía"]), F.initcap(one), pick(74, ["wrote this", "and sons", "of London", ""]))
    live_kinds = [
        (hexes, live), (hexes, live), (hexes, either), (F.substring(b64, 1, 40), live), (F.substring(b64, 1, 40), either), (akia, anywhere),
        (F.concat(F.lit("AKIA"), F.translate(F.upper(F.substring(sha, 1, 16)), "0123456789", "GHJKLMNPQR")), anywhere),
        (F.concat(pick(22, ["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "npm_"]), cut(F.regexp_replace(b64, "[+/]", "x"), 23, 24, 36)), anywhere),
        (F.concat(pick(22, ["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "npm_"]), cut(letters, 23, 20, 36)), anywhere),
        (F.concat(F.lit("eyJ"), F.substring(b64, 1, 17), F.lit("."), F.substring(b64, 5, 30)), anywhere),
        (cut(letters, 20, 16, 40), either), (cut(letters, 20, 16, 40), live), (cut(lower, 21, 16, 40), either), (weak, either), (weak, quoted),
        (F.concat(cut(b64, 24, 4, 9), pick(25, ["&", "!", "#", "@", "$", "%"]), F.substring(b64, 12, 3)), either),
        (cut(sha, 26, 6, 15), either), (cut(b64, 27, 6, 15), either), (cut(letters, 28, 8, 15), either), (cut(lower, 29, 8, 15), quoted),
        (pick(30, ["letmein", "swordfish", "iloveyou", "qwertz", "dragonfly", "sunshine"]), quoted),
        (uuid, header), (weak, user), (cut(b64, 75, 6, 15), user), (weak, told), (cut(sha, 76, 6, 15), told), (F.concat(F.initcap(things[0]), F.substring(digits, 2, 2), things[1]), told),
        (F.concat(F.initcap(things[0]), pick(77, ["", "_", "-", "!"]), F.substring(digits, 2, 2), things[1]), either), (phrase, quoted), (F.substring(b64, 1, 40), keyed),
    ]
    other_kinds = [
        (hexes, noted), (hexes, noted), (hexes, plain), (uuid, noted), (uuid, plain), (F.substring(F.concat(digits, digits), 1, 18), plain), (F.substring(digits, 1, 16), noted),
        (domain, F.concat(word, F.lit("."), F.substring(digits, 2, 2), F.lit("@"))), (domain, anywhere), (where, anywhere), (where, plain),
        (F.concat(F.lit("release-"), F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 2), F.lit("-"), word, F.lit(".html")), anywhere),
        (F.concat(pick(44, ["your-", "my-", "insert-", "the-"]), pick(45, ["api-key-here-", "token-goes-here", "secret-value", "password-here"]), F.substring(digits, 1, 3)), live),
        (F.concat(F.repeat(pick(46, ["x", "X", "0", "*", "a", "-"]), 16), F.substring(digits, 1, 1)), live),
        (F.concat(F.lit("20"), F.substring(digits, 2, 2), F.lit("-01-"), F.substring(digits, 1, 2), F.lit("T10.20.30.000Z")), anywhere),
        (F.concat(one, two, F.substring(digits, 1, 2), three), plain), (F.concat(one, two, three), anywhere),
        (camel, plain), (camel, either), (camel, live), (compound, plain), (compound, bare), (snake, either), (snake, live), (F.upper(snake), either),
        (F.concat_ws("-", one, two, three), anywhere), (F.concat_ws(".", one, two, three), live),
        (one, bare), (F.initcap(one), bare), (F.concat_ws("_", one, pick(16, ["key", "id", "secret", "token"])), either), (F.concat_ws(".", one, two), bare),
        (pick(31, ["None", "null", "true", "false", "string", "required", "optional", "default", "password", "changeme", "example", "your-token", "value", "text", "user_id", "undefined"]), either),
        (pick(32, ["xxxxxxxx", "********", "${TOKEN}", "<token>", "....", "{{secret}}", "%s%s", "$PASSWORD", "os.environ[", "process.env.KEY", "[REDACTED]"]), either),
        (cut(digits, 33, 4, 6), F.concat(word, pick(34, [" tokens: ", " max_tokens=", " token_count = ", " auth: "]))),
        (F.concat(F.lit("//"), domain, F.lit("/"), three), F.concat(pick(35, ["see https:", "auth url: https:", "token from https:"]))),
        (cut(letters, 36, 16, 40), noted), (F.concat(domain, F.lit("/"), pick(37, ["login", "passwords", "Reset", "tokens"])), either),
        (cut(b64, 78, 16, 40), numbered), (letters, numbered), (hexes, numbered), (uuid, numbered), (said, quoted), (named, quoted), (F.concat(F.lit("20"), F.substring(digits, 2, 2)), told),
        (pick(79, ["password", "secret", "changeme", "<password>", "${PASS}", "pass"]), user), (cut(digits, 80, 4, 6), told), (one, keyed), (uuid, noted),
    ]
    label = F.pmod(F.xxhash64(i, F.lit(50)), F.lit(5)) < 2
    choose = lambda kinds, salt, at: F.coalesce(*[F.when(F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(kinds))) == k, x[at]) for k, x in enumerate(kinds)])
    either_of = lambda at: F.when(label, choose(live_kinds, 51, at)).otherwise(choose(other_kinds, 52, at))
    code = pick(8, ["src/app.py", "config/prod.env", "deploy/values.yaml", "notes/setup.txt", "web", "forum", ""])
    fixture = pick(8, ["tests/data/cases.json", "docs/readme.md", "examples/quickstart.py", "test/fixtures.rb"])
    path = F.when(F.pmod(F.xxhash64(i, F.lit(53)), F.lit(100)) < F.when(label, 4).otherwise(40), fixture).otherwise(code)
    made = spark.range(0, rows, 1, 4).select("id", either_of(0).alias("core"), either_of(1).alias("before"), word.alias("after"), path.alias("path"), label.cast("int").alias("label"))
    return made


def fitted_log_odds(found: DataFrame) -> str:
    """For each pair of symbols, the log-odds that it comes from a secret (add-one counts); a row a pair and label on the driver."""
    n = len(SYMBOLS) ** 2
    counts = [[1.0] * n, [1.0] * n]
    for r in found.select("label", F.explode(transitions(F.col("core"))).alias("p")).groupBy("label", "p").count().collect():
        counts[r["label"]][r["p"]] += r["count"]
    total = [sum(c) for c in counts]
    return " ".join(f"{math.log(a / total[1]) - math.log(b / total[0]):.4f}" for b, a in zip(*counts, strict=True))


def _featured(rows: DataFrame, log_odds: str, *kept: str) -> DataFrame:
    """``kept`` and FEATURES of rows with core, before, after and path."""
    rows = rows.withColumn("__pairs", transitions(F.col("core")))
    made = features(F.col("core"), F.col("before"), F.col("after"), F.col("path"), F.col("__pairs"), log_odds)
    return rows.select(*kept, *[c.alias(k) for k, c in made.items()])


def forest(spark: SparkSession, rows: int = 8000, trees: int = 32) -> tuple[RandomForestClassificationModel, str]:
    """The forest and the log-odds of transitions, fitted once an application on the two halves of ``rows`` labelled findings."""
    known = (spark.sparkContext.applicationId, rows, trees)
    if known not in _MODELS:
        found = materialise(labelled_findings(spark, rows).withColumn("half", F.pmod(F.xxhash64("id", F.lit(60)), F.lit(2))), "findings")
        log_odds = fitted_log_odds(found.filter("half = 0"))
        used = materialise(_featured(found.filter("half = 1"), log_odds, "label"), "finding-features")
        used = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(used)
        _MODELS[known] = (RandomForestClassifier(numTrees=trees, maxDepth=9, seed=11, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(used), log_odds)
    return _MODELS[known]


def judged(rows: DataFrame, *kept: str, least: float = 0.5) -> DataFrame:
    """``kept``, score and is_secret of rows with core, before, after and path."""
    model, log_odds = forest(rows.sparkSession)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_featured(rows, log_odds, *kept)))
    return scored.select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias("score")).withColumn("is_secret", F.col("score") >= least)


def _placed(runs: str, gaps: str) -> Callable[[Column, Column], Column]:
    """A run of a word with what stands before and after it.

    Before the first run: two words and the gap. Before a later one: the name that it is assigned to, if the gap ends in one, else the
    gap, the run before it and the gap before that (so a word of many runs is read twice, not once a run).
    """

    def placed(run: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        left = F.when((i > 0) & gap.rlike(NAMED), gap).otherwise(F.concat_ws("", F.get(gaps, i - 1), F.get(runs, i - 1), gap))
        before = F.concat_ws(" ", F.when(i == 0, F.col("s.b2")), F.when(i == 0, F.col("s.b1")), left)
        after = F.when(i == F.size(runs) - 1, F.col("s.a")).otherwise(F.get(gaps, i + 1))
        return F.struct(run.alias("finding"), before.alias("before"), after.alias("after"))

    return placed


def _admitted(r: Column) -> Column:
    x = r["finding"]
    return x.rlike("[0-9]") | (x.rlike("[a-z]") & x.rlike("[A-Z]")) | x.rlike(PREFIX) | F.concat_ws(" ", r["before"], r["after"]).rlike(f"(?i){KEY_WORDS}")


def _masked(text: Column, secret: Column, mask: str) -> Column:
    """Runs go wherever they stand; other values only where no letter or digit continues them."""
    exact = F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), F.replace(secret, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
    by = mask.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(secret.rlike(f"^{SHAPE}$"), F.replace(text, secret, F.lit(mask))).otherwise(F.regexp_replace(text, exact, F.lit(by)))


def find_secrets(docs: DataFrame, keys: list[Column], text: str = "text", path: str | None = "source", least: float = 0.5) -> DataFrame:
    """Per candidate: ``keys``, word_ix (its word, from 0; a word may hold several), finding, score (the forest's) and is_secret."""
    whole = F.coalesce(F.col(text), F.lit(""))
    joined = F.when(whole.contains(MARK), whole).otherwise(F.regexp_replace(whole, INSIDE, f"$1{MARK}"))
    spaced = F.split(swapped(joined, BLANKS[1:], " "), " ")
    names = [f"__key{i}" for i in range(len(keys))]
    named = [k.alias(n) for k, n in zip(keys, names, strict=True)]
    origin = (F.col(path) if path else F.lit("")).cast("string").alias("__path")
    words = docs.select(*named, origin, F.filter(spaced, lambda w: w != "").alias("__w"))
    w = F.col("__w")
    around = F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.get(w, i - 1).alias("b1"), F.get(w, i - 2).alias("b2"), F.get(w, i + 1).alias("a")))
    told = lambda s: F.rtrim(F.lower(s["b1"]), F.lit(":")).isin(*VERBS) & s["x"].rlike("[0-9]")
    signed = lambda s: s["x"].contains("=") | s["x"].contains(":") | F.substring(s["b1"], -1, 1).isin("=", ":", ">") | told(s)
    keyed = lambda s: F.concat_ws(" ", s["b2"], s["b1"], s["x"]).rlike(f"(?i){KEY_WORDS}")
    valued = lambda s: (signed(s) & keyed(s)) | s["x"].rlike(f"{USER}[^\\s/@]+@")
    shaped = F.filter(around, lambda s: ((F.length(s["x"]) >= MIN_CHARS) & s["x"].rlike(SHAPE)) | valued(s))
    rows = words.select(*names, "__path", F.explode(shaped).alias("s"))
    pending = F.regexp_extract(F.concat_ws(" ", "s.b2", "s.b1"), PENDING, 0)
    rows = rows.select(*names, "__path", "s", F.when(valued(F.col("s")), F.concat(pending, F.when(pending != "", " ").otherwise(""), "s.x")).otherwise("").alias("__y"))
    # Columns of their own: inside the lambdas below the expressions would run once a run, not once a word.
    runs = (F.regexp_extract_all("s.x", F.lit(SHAPE), F.lit(0)), F.split("s.x", SHAPE))
    values = (F.regexp_extract_all("__y", F.lit(VALUE), F.lit(0)), F.split("__y", VALUE))
    rows = rows.select(*names, "__path", "s", *[c.alias(n) for c, n in zip((*runs, *values), ("__runs", "__gaps", "__values", "__value_gaps"), strict=True)])
    found = F.concat(
        F.filter(F.transform("__runs", _placed("__runs", "__gaps")), _admitted),
        F.filter(F.transform("__values", _placed("__values", "__value_gaps")), lambda r: ~r["finding"].rlike(f"^{SHAPE}$")),
    )
    rows = rows.select(*names, "__path", F.col("s.i").alias("i"), F.explode(found).alias("r"))
    rows = rows.select(
        *names,
        F.col("i").cast("long").alias("word_ix"),
        F.translate("r.finding", MARK, " ").alias("finding"),
        F.translate("r.finding", MARK, " ").alias("core"),
        F.col("r.before").alias("before"),
        F.col("r.after").alias("after"),
        F.col("__path").alias("path"),
    )
    return judged(rows, *names, "word_ix", "finding", least=least)


def redacted(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = "source", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's text replaced by ``mask``."""
    own, (k, held) = F.xxhash64(F.col(key), F.col(text)), fresh(docs, "__k", "__secrets")
    found = find_secrets(docs, [own], text, path).filter("is_secret")
    secrets = materialise(found.groupBy(F.col("__key0").alias(k)).agg(F.collect_set("finding").alias(held)), "secrets")
    small = F.broadcast if secrets.count() <= MAX_BROADCAST_DOCS else lambda x: x
    joined = docs.withColumn(k, own).join(small(secrets), k, "left")
    masked = F.aggregate(F.reverse(F.array_sort(F.transform(held, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))), F.col(text), lambda t, s: _masked(t, s["s"], mask))
    return joined.withColumn(text, F.when(F.col(held).isNull(), F.col(text)).otherwise(masked)).select(*[F.col(f"`{c}`") for c in docs.columns])
