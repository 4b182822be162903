"""URL filter: host and path rules, and for urls without a rule a logistic regression on hashed character n-grams.

Everything is DataFrame functions: n-grams, hashing, training (gradient steps over the small labelled table) and scoring.
The labelled table is bounded by TRAIN_ROWS (a parameter); the weights are one array of BUCKETS numbers, whatever the input.

The labelled table is a paired design: unwanted and ordinary urls share ends, paths, subdomains and words without meaning, and
differ by a topic word only, so that no end and no path decides. Training lowers the mean loss with a ridge by steps whose
curvature is bounded from above for every weight (no step is too long, and no weight runs away), with momentum; a held-out fifth
tells when to stop.

Defined cases: a null url or one without `://` has an empty host and path, no rule, and the model's verdict on an empty url
(its intercept); repeated rows are judged alike; very long urls are read whole, each gram counts once; other columns of the input
are not read; an empty table gives an empty result; without labelled rows, or with one class only, the model allows all.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GRAM, TRAIN_ROWS, STEPS = 16_384, 4, 20_000, 40

#: host, path, verdict
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: Topic words of unwanted and of ordinary sites, and syllables of words that mean nothing: the labelled table is built from them.
UNWANTED = (
    "casino casinos poker betting bets gamble gambling jackpot slots roulette lottery bingo pills pharmacy viagra cialis steroids porn porno xxx adult adults nude sex sexy sexcam escort escorts singles hookup "
    "spam spammer ads adserver adclick tracker tracking track clickbait linkfarm popunder banners warez crack cracked keygen torrent torrents payday loans replica fakes phishing malware prizes winner freebies cheap cheapest free"
).split()
ORDINARY = (
    "news library school garden museum recipes weather history science travel forum wiki journal music health city sports research kitchen letters books market teacher river college theatre bakery farm hotel church "
    "hospital council airport railway bank energy software design photo camera nature forest mountain ocean animal family children football cycling painting poetry physics biology chemistry language dictionary maps town village station bridge"
).split()
SYLLABLES = "the er in on an re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve al me ne ra co ma la".split()
#: Ends, subdomains and paths; every class has all of them alike.
ENDS = "com net org info co.uk de fr io xyz top biz site online".split()
SUBDOMAINS = ("", "www.", "blog.", "m.", "shop.")
PATHS = ["/", "", "/{n}", "/{n}.html", "/en/{n}", "/de/{n}/?id={n}", "/fr/{n}", "/about", "/es/{n}.html", "/index.php?p={n}", "/go/{n}", "/{w}/{n}", "/item-{n}"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, bad (1 or 0). For every shape of url (join, subdomain, end, path, meaningless word) there is an
    unwanted and an ordinary one, and half as many without a topic, which are ordinary."""
    made = ["".join(p) for k, p in enumerate(product(SYLLABLES, SYLLABLES)) if k % 3 == 0] + ["".join(p) for k, p in enumerate(product(SYLLABLES[:14], SYLLABLES[:14], SYLLABLES)) if k % 9 == 0]
    joins = ("{t}-{w}", "{t}{w}", "{w}-{t}", "{w}{t}", "{t}.{w}", "{t}", "{w}-{t}-{x}")
    rows = []
    for k in range(7 * len(UNWANTED) * 9):
        w, x = made[k * 31 % len(made)], made[(k * 17 + 5) % len(made)]
        shape = f"http{'s' * (k % 2)}://{SUBDOMAINS[k * 3 % 5]}" + "{host}." + ENDS[k * 5 % len(ENDS)] + PATHS[(k * 7 + k // 13) % len(PATHS)].format(n=k * 7919 % 9973, w=x)
        for bad, topics in ((1, UNWANTED), (0, ORDINARY)):
            rows.append((shape.format(host=joins[k % 7].format(t=topics[k // 7 % len(topics)], w=w, x=x)), bad))
        if k % 2:
            rows.append((shape.format(host=(w, f"{w}-{x}", f"{w}{x}")[k // 2 % 3]), 0))
    return spark.createDataFrame(rows, "url string, bad int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Rules are configuration, compared in place."""
    fit = [F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    return F.coalesce(*fit, F.lit(None).cast("struct<rule:string,verdict:string>"))


def grams(host: Column, path: Column, n: int = GRAM, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the distinct character n-grams of `^host$` and of the path."""

    def of(text: Column, seed: int) -> Column:
        characters = F.split(text, "")
        found = characters
        for k in range(2, n + 1):  # in step along the array, so that time is in proportion to the text
            found = F.zip_with(found, F.slice(characters, F.lit(k), F.size(characters)), lambda a, b: F.concat(a, b))
        found = F.when(F.length(text) < n, F.array(text)).otherwise(F.filter(found, lambda x: x.isNotNull()))
        return F.transform(found, lambda x: F.pmod(F.xxhash64(F.lit(seed), x), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(of(F.concat(F.lit("^"), host, F.lit("$")), 1), of(path, 2)))


def featured(labelled: DataFrame, rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """bad, held (whether held out), g (the grams, and `buckets` for the intercept) of at most `rows` labelled rows, the first by hash."""
    host, path = host_and_path(F.col("url"))
    x = labelled.where("bad is not null").orderBy(F.xxhash64("url"), "url", "bad").limit(rows)
    return x.select(F.col("bad").cast("double").alias("bad"), (F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(5)) == 0).alias("held"), F.concat(grams(host, path, buckets=buckets), F.array(F.lit(buckets))).alias("g"))


def train(labelled: DataFrame, steps: int = STEPS, ridge: float = 2e-5, rows: int = TRAIN_ROWS, buckets: int = BUCKETS, patience: int = 4, history: list | None = None) -> list[float]:
    """Weights of the buckets and, last, the intercept: logistic regression with a ridge. Both classes weigh alike, whatever their
    numbers. Each step is one grouped sum over the table.

    A url's features have norm 1, each 1 / root of their number; so the loss bends along weight k by at most a quarter of the
    share of urls that have it, if all weights move at once. Steps divide by that bound and therefore never overshoot; momentum
    starts anew when the loss rises. It stops when the loss of the held-out fifth has not fallen for `patience` steps, and
    returns the weights where that was least. `history` gets (loss with ridge, held-out loss) before each step.
    """
    x = featured(labelled, rows, buckets).coalesce(1).cache()
    count = {(r["held"], r["bad"]): r["n"] for r in x.groupBy("held", "bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count.get((False, 1.0)) or not count.get((False, 0.0)):
        x.unpersist()
        return [0.0] * (buckets + 1)
    share = F.lit(0.0)
    for (held, bad), n in count.items():  # each class half, in training and held-out rows alike
        share = F.when((F.col("held") == held) & (F.col("bad") == bad), 0.5 / n).otherwise(share)
    x = x.withColumn("w", share)
    bend = [0.0] * (buckets + 1)
    for k, n in x.where("NOT held").select(F.explode("g").alias("k"), "w").groupBy("k").agg(F.sum("w")).collect():  # at most buckets + 1 rows
        bend[k] = 0.25 * n
    now, ahead, turn = [0.0] * (buckets + 1), [0.0] * (buckets + 1), 1
    best, least, since, last = now, float("inf"), 0, float("inf")
    for _ in range(steps):
        m = x.select("g", "bad", "held", "w", _margin(F.col("g"), ahead).alias("m"))
        p, loss = 1 / (1 + F.exp(-F.col("m"))), F.col("w") * (F.greatest("m", F.lit(0.0)) - F.col("m") * F.col("bad") + F.log1p(F.exp(-F.abs("m"))))
        entry = lambda k, d: F.struct(k.alias("k"), d.alias("d"))
        told = F.array(entry(F.when(F.col("held"), -1).otherwise(-2), loss))
        part = F.when(F.col("held"), told).otherwise(F.concat(told, F.transform("g", lambda k: entry(k, F.col("w") * (p - F.col("bad")) / F.sqrt(F.size("g"))))))
        d = {r["k"]: r["d"] for r in m.select(F.explode(part).alias("e")).groupBy("e.k").agg(F.sum("e.d").alias("d")).collect()}  # at most buckets + 3 rows
        whole = d.pop(-2) + ridge / 2 * sum(v * v for v in ahead)
        held = d.pop(-1, whole)
        if history is not None:
            history.append((whole, held))
        best, least, since = (ahead, held, 0) if held < least else (best, least, since + 1)
        if since >= patience:
            break
        turn, last = (1 if whole > last else turn + 1), whole
        after = [v - (d.get(k, 0.0) + ridge * v) / (bend[k] + ridge) for k, v in enumerate(ahead)]
        now, ahead = after, [v + (turn - 1) / (turn + 2) * (v - u) for u, v in zip(now, after)]
    x.unpersist()
    return best


def _margin(g: Column, weights: list[float]) -> Column:
    w = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")
    return F.aggregate(g, F.lit(0.0), lambda a, k: a + F.element_at(w, k + 1)) / F.sqrt(F.size(g))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: list[float], most: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability that the url is unwanted."""
    host, path = host_and_path(F.col("url"))
    x = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    x = x.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    g = F.concat(grams(F.col("host"), F.col("path"), buckets=len(weights) - 1), F.array(F.lit(len(weights) - 1)))
    x = x.withColumn("bad_probability", 1 / (1 + F.exp(-_margin(g, weights))))
    return x.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.when(F.col("bad_probability") > most, "block").otherwise("allow")).alias("verdict"), "bad_probability")
