"""Secret scanning through a trigram inverted index, in DataFrame functions alone.

Each rule's regular expression gives a Boolean trigram query (``trigrams``).
One pass over the texts makes postings, trigram to text, for the trigrams that
some query names; postings are intersected by counting, which gives the
candidate texts of each rule. Candidates go back to the texts as a table of
masks of a bounded size and are verified by the expression itself. Rules
without mandatory trigrams scan every text.

Positions come from the pieces between the matches: a match starts where the
pieces and matches before it end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import trigrams


#: rows of the table of masks that is broadcast, at most
SLOTS = 1 << 19


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has under ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base kinds of the contract, then public key formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    # maximal runs; the same spans as runs of any length with the short ones dropped
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of the rule's matches, in code points."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.split(text, rule.pattern, -1)
    wanted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    zipped = F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("part"), hits.alias("hit"), wanted.alias("wanted"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(F.length(x["2"]) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    zipped = zipped.cast("array<struct<`0`:string,`1`:string,`2`:string>>")
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def queries(rules: tuple[Rule, ...]) -> dict[str, trigrams.Query]:
    """The trigram query of each rule that has one."""
    found = {r.kind: trigrams.rare(trigrams.query_of(r.pattern)) for r in rules}
    return {kind: query for kind, query in found.items() if query}


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index of docs (text_hash, text): (trigram, text_hash) for every trigram that a rule's query names, by one pass over each text."""
    named = sorted({t for query in queries(rules).values() for clause in query for way in clause for t in way})
    if not named:
        return docs.select("text_hash", F.lit("").alias("trigram")).limit(0)
    found = F.regexp_extract_all(F.lower("text"), F.lit(trigrams.scanner(named)), F.lit(1))
    return docs.select("text_hash", F.explode(F.array_distinct(found)).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_hash, rules): the rules whose trigram query a text's postings satisfy."""
    # one literal map from a trigram to its uses: as small as the rules
    by: dict[str, list[str]] = {}
    for kind, query in queries(rules).items():
        for c, clause in enumerate(query):
            for w, way in enumerate(clause):
                for t in way:
                    by.setdefault(t, []).append(f"{kind}:{c}:{w}:{len(way)}:{len(query)}")
    uses = F.create_map(*[x for t in sorted(by) for x in (F.lit(t), F.array(*map(F.lit, by[t])))]) if by else F.lit(None).cast("map<string,array<string>>")
    used = index.dropDuplicates().select("text_hash", F.explode(uses[F.col("trigram")]).alias("use"))
    met = used.groupBy("text_hash", "use").agg(F.count("*").alias("n"))
    part = F.split("use", ":")
    met = met.filter(F.col("n") == part[3].cast("int")).select("text_hash", part[0].alias("kind"), part[1].alias("clause"), part[4].cast("int").alias("clauses"))
    whole = met.groupBy("text_hash", "kind").agg(F.count_distinct("clause").alias("n"), F.max("clauses").alias("clauses"))
    return whole.filter("n = clauses").groupBy("text_hash").agg(F.sort_array(F.collect_set("kind")).alias("rules"))


def _slot(text_hash: Column) -> Column:
    return F.pmod(text_hash, F.lit(SLOTS)).cast("int")


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, text, found): each row whole, its text, and the spans in it.

    Candidates go to the texts as a table of at most SLOTS masks of rules, by
    hash of the text, so no text moves; a text that shares a slot with a
    candidate is verified in vain.
    """
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    docs = docs.select("row", F.coalesce(F.col("row.text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    chosen = candidates(postings(docs.select("text_hash", "text"), rules), rules)
    kinds = list(queries(rules))
    bits = [F.when(F.array_contains("rules", k), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, k in enumerate(kinds)]
    mask = reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))
    masks = chosen.groupBy(_slot(F.col("text_hash")).alias("of")).agg(F.bit_or(mask).alias("mask"))
    joined = docs.withColumn("slot", _slot(F.col("text_hash"))).join(F.broadcast(masks), F.col("slot") == F.col("of"), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    text = F.col("text")
    spans = []
    for i, r in enumerate(rules):
        asked = F.col("mask").bitwiseAND(F.lit(1 << kinds.index(r.kind))) > 0 if r.kind in kinds else text.rlike(r.pattern)
        spans.append(F.when(asked, _spans(text, r, i)).otherwise(none))
    return joined.select("row", "text", F.array_sort(F.flatten(F.array(*spans))).alias("found"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets of every document of ``docs`` (doc_id, text).

    Returns each row's columns and ``found``, an array of (start, rank, kind,
    end) by start, then rule order. Null text counts as empty; a null doc_id
    is a value like others; repeated rows each get the same result; further
    columns stay, but for one named found; an empty table gives no rows.
    """
    own = [F.col(f"row.`{c}`") for c in docs.columns if c != "found"]
    return _scanned(docs, rules).select(*own, "found")


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count of each base kind, base_sha256 and all spans."""
    found = F.col("found")
    base = [r.kind for r in rules if r.base]
    own = F.filter(found, lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return scan_secrets(docs, rules).select("doc_id", *counts, F.sha2(digest(own), 256).alias("base_sha256"), digest(found).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{}]") -> DataFrame:
    """The same rows with each secret in the text replaced by its kind; overlapping spans become one, named by the first.

    Null text stays null, and all other columns stay as they are, whatever
    their names; repeated rows are treated alike; an empty table gives no rows.
    """

    def step(acc: Column, s: Column) -> Column:
        text = F.col("text")
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.format_string(mark.replace("{}", "%s"), s["kind"]))
        over = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(over, acc["out"]).otherwise(put).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length(F.col("text")))))
    clean = F.when(F.size("found") == 0, F.col("row.text")).otherwise(whole)
    return _scanned(docs, rules).select(*[clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
