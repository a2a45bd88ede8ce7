"""PII by bootstrapped contextual extraction.

Spans that the base patterns find are seeds. The words around seeds induce lexical patterns, and
identifier-like tokens in the same contexts are instances. Spark scores patterns by the reliability
of their instances and instances by that of their other contexts, in turn, so that instances found
in one round support patterns that no seed stands in; instances that reliable patterns hold become
spans of the seeds' kind. DataFrame functions only.

Matches are located by putting marks around them and cutting the text there, which gives offsets in
code points without leaving Spark's functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.session import scratch_dir

# Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")

# Marks are noncharacters; where a text holds one it counts as SPARE, which no pattern matches.
BROKEN, OPEN, SHUT, SPARE = "﷐", "﷑", "﷒", "﷓"

# The base patterns, written so that no start inside a run that has failed is tried again and no
# group is repeated without bound. BROKEN stands between two dots, or between two of blank and
# hyphen: an email's domain and a card number end there.
LOCAL = r"A-Za-z0-9._%+\-"
EMAIL = (rf"(?:(?<![{LOCAL}{BROKEN}])|\G)[{LOCAL}][{LOCAL}{BROKEN}]*+@[A-Za-z0-9\-]++"
         r"\.[A-Za-z0-9\-.]*[A-Za-z0-9\-]")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9][0-9 \-]*[0-9]"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# What a text must hold before it is searched for a kind.
MAY_HOLD_IP = r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"
MAY_HOLD_CARD = r"[0-9](?:[ \-]?[0-9]){11}"
# An instance: a token with an @ or at least six digits, which may be spread over it.
NOT_SPACE = r"[^\x20\x09-\x0D]"
TOKEN = rf"(?<!{NOT_SPACE})[^\x20\x09-\x0D0-9@]*+[0-9@]{NOT_SPACE}*+"
IDENTIFIER = r"@|(?:[0-9][^0-9]*){6}"
MAY_HOLD_IDENTIFIER = r"@|[0-9][^\x20\x09-\x0D]*[0-9]"

CONTEXT = 48                # code points that are context on either side; a longer word counts by what lies there
CHUNK = 256                 # matches gathered at a time, so that appending stays cheap
ROUNDS = 2                  # a round finds identifiers and the patterns that these support
LEAST_RELIABLE = 0.5        # patterns and instances below that find nothing new
LEAST_SEEDS = 3             # different seeds or found identifiers a pattern needs
DOUBT = 2.0                 # unconfirmed instances that every pattern is charged with

MATCH = "struct<start:int,stop:int,found:string,before:string,after:string>"


def locate(text: Column, pattern: str) -> Column:
    """Each match of a pattern: start, stop (code points), found, and the text on either side.

    ``text`` holds no OPEN or SHUT; BROKEN marks in it do not count as characters.
    """
    marked = F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{OPEN}$1{SHUT}"))
    parts = F.split(F.translate(marked, BROKEN, ""), OPEN)

    def step(state: Column, part: Column) -> Column:
        found, rest = F.substring_index(part, SHUT, 1), F.substring_index(part, SHUT, -1)
        here = F.struct(
            state["at"].alias("start"), (state["at"] + F.length(found)).alias("stop"),
            found.alias("found"), F.right(state["last"], F.lit(CONTEXT)).alias("before"),
            F.left(rest, F.lit(CONTEXT)).alias("after"))
        first = state["at"] < 0
        return F.struct(
            F.when(first, F.length(part)).otherwise(state["at"] + F.length(part) - 1).alias("at"),
            F.when(first, part).otherwise(rest).alias("last"),
            F.when(first, state["out"]).otherwise(F.concat(state["out"], F.array(here))).alias("out"))

    none = F.array().cast(f"array<{MATCH}>")

    def chunk(state: Column, some: Column) -> Column:
        start = F.struct(state["at"].alias("at"), state["last"].alias("last"), none.alias("out"))
        return F.aggregate(some, start, step, lambda s: F.struct(
            s["at"].alias("at"), s["last"].alias("last"),
            F.concat(state["out"], F.array(s["out"])).alias("out")))

    def gather(parts: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")),
                             lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(F.lit(-1).alias("at"), F.lit("").alias("last"),
                         F.array().cast(f"array<array<{MATCH}>>").alias("out"))
        return F.aggregate(chunks, start, chunk, lambda s: F.flatten(s["out"]))

    return F.transform(F.array(parts), gather)[0]


def luhn(found: Column) -> Column:
    """Whether the digits of a string, 12 to 19 of them, pass the checksum."""
    digits = F.split(F.reverse(F.regexp_replace(found, "[^0-9]", "")), "")
    digits = F.filter(digits, lambda d: d != "")

    def add(total: Column, pair: Column) -> Column:
        twice = pair["d"] * 2
        return total + F.when(pair["i"] % 2 == 0, pair["d"]).otherwise(
            F.when(twice > 9, twice - 9).otherwise(twice))

    numbered = F.transform(digits, lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    total = F.aggregate(numbered, F.lit(0), add)
    return F.size(digits).between(12, 19) & (total % 10 == 0)


def base_matches(text: Column) -> dict[str, Column]:
    """Arrays of valid matches by kind."""
    none = F.array().cast(f"array<{MATCH}>")
    broken = lambda pair: F.regexp_replace(text, pair, BROKEN)
    digits = lambda m: F.length(F.regexp_replace(m["found"], "[^0-9]", ""))
    return {
        "email": F.when(F.contains(text, F.lit("@")), locate(broken(r"(?<=\.)(?=\.)"), EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(MAY_HOLD_IP), F.filter(
            locate(text, IP), lambda m: m["found"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))).otherwise(none),
        "card": F.when(text.rlike(MAY_HOLD_CARD), F.filter(
            locate(broken(r"(?<=[ \-])(?=[ \-])"), CARD), lambda m: luhn(m["found"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(
            locate(text, PHONE), lambda m: digits(m).between(9, 15))).otherwise(none),
    }


def contexts(match: Column) -> Column:
    """The lexical patterns a match stands in: the words before, and the words on both sides."""
    plain = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[0-9]", "0"),
                                       r"[^\p{L}\p{N}=:]+"), lambda w: w != "")
    before, after = plain(match["before"]), plain(match["after"])
    one = F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit(""))
    two = F.concat_ws(" ", F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit("")), one)
    nxt = F.coalesce(F.try_element_at(after, F.lit(1)), F.lit(""))
    return F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two),
                   F.concat(F.lit("3 "), one, F.lit(" _ "), nxt))


def located(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """(keep…, row, base, tokens): base spans with their contexts, and instances beside them."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")),
                       BROKEN + OPEN + SHUT, SPARE * 3)
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
                       F.monotonically_increasing_id().alias("row"), text.alias("text"))
    none = F.array().cast(f"array<{MATCH}>")
    found = base_matches(F.col("text"))
    tokens = F.when(F.col("text").rlike(MAY_HOLD_IDENTIFIER), F.filter(
        locate(F.col("text"), TOKEN), lambda m: m["found"].rlike(IDENTIFIER))).otherwise(none)

    def shown(match: Column, kind: int) -> Column:
        return F.struct(match["start"].alias("start"), F.lit(kind).alias("kind"), match["stop"].alias("stop"),
                        F.xxhash64(match["found"]).alias("name"), contexts(match).alias("patterns"))

    def all_shown(matches: Column, kind: int) -> Column:
        return F.transform(matches, lambda m: shown(m, kind))

    base = F.concat(*(all_shown(found[k], i) for i, k in enumerate(KINDS)))
    return rows.select(*(f"k{i}" for i in range(len(keep))), "row", F.sort_array(base).alias("base"),
                       all_shown(tokens, -1).alias("tokens"))


def occurrences(rows: DataFrame) -> DataFrame:
    """(row, start, stop, kind, name, patterns): seeds, and tokens apart from every base span (kind -1)."""
    seeds = rows.select("row", F.inline("base"))
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (
        b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    return seeds.unionByName(rows.select("row", F.inline(apart)))


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, reliability) of the patterns that may find new identifiers.

    The graph ties every different identifier (by its text) to the contexts it stands in, each a set of
    patterns, and counts a context once per identifier, so copies of a document add nothing. A seed
    counts fully for its kind. In each round an unconfirmed identifier vouches for a pattern with the
    mean reliability of its other contexts, those without the pattern, a context being as reliable
    as its best pattern; so no pattern confirms itself. One that vouches with LEAST_RELIABLE or more
    counts as found, like a seed. A pattern's reliability is what its identifiers add up to, divided by
    their number and DOUBT more, once LEAST_SEEDS of them are seeds or found; so what earlier rounds have
    found leads to patterns that no seed stands in.
    """
    spark, folder, kinds = found.sparkSession, scratch_dir(found.sparkSession, "pii"), range(len(KINDS))

    def kept(table: DataFrame, name: str) -> DataFrame:
        """Written, so that every plan stays small."""
        table.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    seen = found.groupBy("name", F.array_sort(F.array_distinct("patterns")).alias("patterns")).agg(F.max("kind").alias("kind"))
    own = kept(seen.select("name", "kind", F.xxhash64("patterns").alias("context"), F.explode("patterns").alias("pattern")), "contexts")
    edges = own.groupBy("name", "pattern").agg(F.max("kind").alias("kind"))
    counts = kept(edges.groupBy("pattern").agg(F.count("*").alias("n"), *(
        F.sum((F.col("kind") == i).cast("long")).alias(f"seeds{i}") for i in kinds)), "counts")
    # an identifier that is a seed anywhere is no unconfirmed one
    seeds = own.filter("kind >= 0").select("name").distinct()
    unsure = kept(own.join(seeds, "name", "left_anti").select("name", "context", "pattern"), "unsure")
    vouching = kept(unsure.groupBy("name", "pattern").agg(F.count("*").alias("here")).join(
        unsure.groupBy("name").agg(F.countDistinct("context").alias("contexts")), "name").select(
        "name", "pattern", (F.col("contexts") - F.col("here")).alias("others")).filter("others > 0"), "vouching")

    def scored(patterns: DataFrame, gain: list[Column], support: list[Column]) -> DataFrame:
        return patterns.select("pattern", *(F.when(
            F.col(f"seeds{i}") + support[i] >= LEAST_SEEDS, (F.col(f"seeds{i}") + gain[i]) / (F.col("n") + DOUBT))
            .otherwise(0.0).alias(f"r{i}") for i in kinds)).filter(" or ".join(f"r{i} > 0" for i in kinds))

    none = [F.lit(0)] * len(KINDS)
    patterns = kept(scored(counts, none, none), "patterns")
    for k in range(rounds):
        # a context without a scored pattern counts as 0
        reliable = kept(unsure.join(patterns, "pattern").groupBy("name", "context").agg(
            *(F.max(f"r{i}").alias(f"c{i}") for i in kinds)), f"reliable{k}")
        total = reliable.groupBy("name").agg(*(F.sum(f"c{i}").alias(f"t{i}") for i in kinds))
        with_it = unsure.join(reliable, ["name", "context"]).groupBy("name", "pattern").agg(
            *(F.sum(f"c{i}").alias(f"w{i}") for i in kinds))
        vouched = vouching.join(total, "name").join(with_it, ["name", "pattern"], "left").select("pattern", *(
            ((F.col(f"t{i}") - F.coalesce(f"w{i}", F.lit(0.0))) / F.col("others")).alias(f"m{i}") for i in kinds))
        gains = kept(vouched.groupBy("pattern").agg(
            *(F.sum(F.when(F.col(f"m{i}") >= LEAST_RELIABLE, 1.0).otherwise(F.col(f"m{i}"))).alias(f"g{i}") for i in kinds),
            *(F.sum((F.col(f"m{i}") >= LEAST_RELIABLE).cast("long")).alias(f"s{i}") for i in kinds)), f"gains{k}")
        filled = lambda c: [F.coalesce(F.col(f"{c}{i}"), F.lit(0)) for i in kinds]
        patterns = kept(scored(counts.join(gains, "pattern", "left"), filled("g"), filled("s")), f"patterns{k}")
    best = F.greatest(*(F.col(f"r{i}") for i in kinds))
    kind = F.coalesce(*(F.when(F.col(f"r{i}") == best, F.lit(i)) for i in kinds))
    return patterns.select("pattern", kind.alias("kind"), best.alias("reliability")).filter(
        F.col("reliability") >= LEAST_RELIABLE)


def find_pii(docs: DataFrame, *keep: str, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The columns ``keep`` with ``base`` and ``spans``: sorted arrays of (start, kind, stop).

    ``base`` are the valid matches of the base patterns, kinds numbered as in KINDS, and ``spans``
    adds the discovered ones. Offsets count code points; a null text counts as empty and has no
    spans. Rows are searched one by one, so repeated rows get equal spans.
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession, "located")
    located(docs, keep, text_col).write.parquet(folder)
    rows = spark.read.parquet(folder)
    found = occurrences(rows)
    reliable = bootstrap(found, rounds)
    tokens = found.filter("kind < 0").select("row", "start", "stop", "name", F.explode("patterns").alias("pattern"))
    added = (tokens.join(reliable, "pattern").groupBy("row", "start", "stop", "kind").agg(
                F.max("reliability").alias("reliability"))
             .groupBy("row", "start", "stop").agg(F.max_by("kind", F.struct("reliability", -F.col("kind"))).alias("kind"))
             .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("added")))
    added.write.parquet(f"{folder}_added")      # its size is then known: a few rows move no others
    added = spark.read.parquet(f"{folder}_added")
    plain = F.transform("base", lambda b: F.struct(
        b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return rows.join(added, "row", "left").select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), plain.alias("base"),
        F.sort_array(F.concat(plain, F.coalesce("added", none))).alias("spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    name = lambda kind: F.element_at(F.array(*(F.lit(k) for k in KINDS)), kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in capitals and brackets.

    Spans that overlap an earlier one are replaced with it, under the earlier one's kind.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(s["start"] < state["at"], state["out"]).otherwise(
                F.concat(state["out"], F.array(gap, F.element_at(names, s["kind"] + 1)))).alias("out"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    rows = find_pii(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
                       F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
                       spelled(F.col("spans")).alias("spans"))
