"""Problem 10: text cut off by field limits or broken transfers.

A stack automaton reads each whole text: fences, inline code, brackets, quotes
of all kinds and markup tags open and close, escapes are skipped, and at the
end stand what stays open, whether a character, escape, entity or tag broke
off, and whether the last sentence has a terminator. Each finding is held
against its source's baseline, computed over all rows:

- what stays open is evidence unless the source's terminated texts leave it
  open too (more than HARMLESS of them, and more than two);
- a missing terminator is evidence unless most texts of the source lack one;
- a cut mark (... or an ellipsis) counts at a length that is a limit of the
  source: its greatest one, or one at which marked texts pile up, where most
  texts of that length end in the mark;
- a single line without terminator is a title where the source's texts begin
  with such lines;
- a signature is cut where it is a proper prefix of a far more frequent one.

A complete text is no case, whatever its length or last character. Null and
blank texts give no row. A null source has a baseline of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.rowmap import flat_map
from quarrylens.session import checkpointed, spread
from quarrylens.sources.tables import table

_END = ".!?。！？．؟।"
_CLOSERS = "\"')]}»”’」』*_"
_SENTENCE = re.compile(rf"[.!?]+[{re.escape(_CLOSERS)}]*\s+|[。！？]+[{re.escape(_CLOSERS)}]*")
_SIGNATURE = re.compile(r"\n-- ?\r?\n[ \t]*([^\r\n]+)\Z")
_BULLET = re.compile(r"[ \t]*(?:[-*+•]|\d+[.)])[ \t]")
_FIRST = re.compile(r"\s*([^\r\n]*)\r?\n")
#: Words with a dot that ends no sentence (fixed values).
_ABBREVIATED = frozenset("cf. no. nr. e.g. i.e. vs. z.b. bzw. ca. etc. p.ex. np. tj. t.d. д. т.е.".split())
#: What closes each opener (fixed values); straight quotes close themselves.
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“”", "‚": "‘’", "「": "」", "『": "』", "（": "）", '"': '"'}
_CLOSING = frozenset("".join(_PAIRS.values())) - {'"', "“"}
_EVENT = re.compile(r"^[ \t]*(?P<fence>```|~~~)|(?P<escape>\\.)|(?P<tick>`)|<(?P<close>/?)(?P<tag>[A-Za-z][\w-]*)(?:\s[^<>]*)?(?P<empty>/?)>|[()\[\]{}«»“”„‚‘’「」『』（）\"]", re.M | re.S)
#: Tags that enclose nothing (fixed values).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BROKEN = re.compile(r"[\x00-\x08\x0e-\x1f\ud800-\udfff\ufffd]\Z|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)\Z|&#?\w{1,6}\Z|<[a-zA-Z/][^<>\s]*\Z")
#: Share of a source's terminated texts that leave a thing open, beyond which that is harmless there.
HARMLESS = 0.02
#: Share of a source's texts without terminator from which one need not be there.
BARE = 0.5
#: Share of a source's marked texts, and how many, that make their length a limit.
PILE, PILE_LEAST = 0.2, 5
#: Share of a source's many-line texts whose first line is a title, from which lone titles count as complete.
TITLES = 0.5
#: A signature is cut where a longer one with the same start occurs this many times as often.
OFTENER = 3


def left_open(text: str) -> list[str]:
    """What a text leaves open, outermost first: openers, `fence`, `` ` `` and tags as <name>."""
    stack: list[str] = []
    for m in _EVENT.finditer(text):
        c, top = m.group(), stack[-1] if stack else ""
        if m["fence"]:
            mark = m["fence"]
            if top == mark:
                stack.pop()
            elif top not in ("```", "~~~"):
                if top == "`":
                    stack.pop()
                stack.append(mark)
        elif top in ("```", "~~~") or m["escape"]:
            continue
        elif m["tick"]:
            if top == "`":
                stack.pop()
            else:
                stack.append("`")
        elif top == "`":
            continue
        elif m["tag"]:
            name = f"<{m['tag'].lower()}>"
            if m["close"]:
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif not m["empty"] and name[1:-1] not in _VOID:
                stack.append(name)
        elif c == "“" and "„" in stack:
            del stack[len(stack) - 1 - stack[::-1].index("„") :]
        elif c == '"' and c in stack:
            del stack[len(stack) - 1 - stack[::-1].index(c) :]
        elif c in _CLOSING:
            # What was opened within goes with the pair that closes around it; a closer alone (as in a list's 1) is none.
            for k in range(len(stack) - 1, -1, -1):
                if c in _PAIRS.get(stack[k], ""):
                    del stack[k:]
                    break
            else:
                if c == "»":  # quotes of the other direction
                    stack.append("»")
        elif c == "«" and "»" in stack:
            del stack[len(stack) - 1 - stack[::-1].index("»") :]
        elif c in _PAIRS:
            stack.append(c)
    return ["fence" if x in ("```", "~~~") else x for x in stack]


def ending(text: str) -> tuple[str, list[str], str | None]:
    """(how the text ends, what stays open, its signature): complete, broken, bare, ellipsis, dots, title or signature."""
    t = text.rstrip()
    bare = t.rstrip("\x00\ufffd")
    if _BROKEN.search(t):
        return "broken", [], None
    stack = left_open(bare)
    if not bare or "fence" in stack:
        return "complete", stack, None
    line = bare[bare.rfind("\n") + 1 :]
    if re.match(r"[ \t]*(?:```|~~~)\Z", line):
        return "complete", stack, None
    m = _SIGNATURE.search(bare)
    if m:
        return "signature", stack, m[1].rstrip()
    if bare.endswith("…"):
        return "ellipsis", stack, None
    if bare.endswith("..."):
        return "dots", stack, None
    core = bare.rstrip(_CLOSERS)
    if bare[-1] in _END or (core and core[-1] in _END and len(bare) - len(core) <= 3):
        return ("bare" if line.rsplit(None, 1)[-1].lower() in _ABBREVIATED else "complete"), stack, None
    if _BULLET.match(line) and bare[-1] == "`" and not left_open(line):
        return "complete", stack, None
    if "\n" not in bare.strip() and not _SENTENCE.search(bare) and not stack:
        return "title", stack, None
    return "bare", stack, None


def endings(docs: DataFrame) -> DataFrame:
    """One row per text that is not blank: how it ends, what stays open, and what its source's baselines need of it."""

    def rows(doc_id, source, text):
        if text.strip():
            how, stack, signature = ending(text)
            m = _FIRST.match(text.rstrip())
            first = m[1].rstrip() if m else ""
            yield doc_id, source, len(text), how, sorted(set(stack)), signature, bool(first), bool(first) and first[-1] not in ".!?。！？:,`"

    return flat_map(spread(docs.select("doc_id", "source", "text").where(F.col("text").isNotNull())), lambda: rows,
                    "doc_id long, source string, n_chars int, how string, open array<string>, signature string, many boolean, titled boolean")


def limits(e: DataFrame) -> DataFrame:
    """(key, n_chars, how): lengths of a source at which a mark means a cut."""
    per = e.groupBy("key", "n_chars").agg(F.count("*").alias("n"), *(F.count_if(F.col("how") == m).alias(m) for m in ("ellipsis", "dots")))
    totals = per.groupBy("key").agg(F.max("n_chars").alias("longest"), *(F.sum(m).alias(f"all_{m}") for m in ("ellipsis", "dots")))
    marked = F.explode(F.array(*(F.struct(F.lit(m).alias("how"), F.col(m).alias("m"), F.col(f"all_{m}").alias("all")) for m in ("ellipsis", "dots"))))
    piled = (F.col("x.m") >= PILE_LEAST) & (F.col("x.m") >= PILE * F.col("x.all"))
    return (per.where("ellipsis + dots > 1").join(totals, "key").withColumn("x", marked)
            .where((F.col("x.m") * 2 > F.col("n")) & ((F.col("n_chars") == F.col("longest")) | piled)).select("key", "n_chars", "x.how", F.lit(True).alias("at_limit")))


def baselines(e: DataFrame) -> DataFrame:
    """(key, titled_source, bare_source): one row per source, by sums that combine on the map side."""
    many, bare = F.count_if("many"), F.count_if((F.col("how") == "bare") & (F.size("open") == 0))
    return e.groupBy("key").agg(((many > 0) & (F.count_if("titled") >= TITLES * many)).alias("titled_source"), ((bare > BARE * F.count("*")) & (bare > 2)).alias("bare_source"))


def harmless(e: DataFrame) -> DataFrame:
    """(key, harmless): what the terminated texts of a source leave open."""
    done = e.where("how = 'complete' AND NOT array_contains(open, 'fence')")
    n = done.groupBy("key").agg(F.count("*").alias("n"))
    left = done.where(F.size("open") > 0).select("key", F.explode("open").alias("x")).groupBy("key", "x").agg(F.count("*").alias("m"))
    return left.join(n, "key").where((F.col("m") > 2) & (F.col("m") > HARMLESS * F.col("n"))).groupBy("key").agg(F.collect_set("x").alias("harmless"))


def cut_signatures(e: DataFrame) -> DataFrame:
    """Signatures that are proper prefixes of far more frequent ones, by hashed prefixes of those that are frequent."""
    signatures = e.where(F.col("how") == "signature").groupBy("signature").agg(F.count("*").alias("n"))
    starts = (signatures.where(F.col("n") >= OFTENER).withColumn("k", F.explode(F.sequence(F.lit(1), F.length("signature"))))
              .where(F.col("k") < F.length("signature"))
              .groupBy("k", F.xxhash64(F.expr("left(signature, k)")).alias("h")).agg(F.max("n").alias("longer")))
    hashed = signatures.withColumn("k", F.length("signature")).withColumn("h", F.xxhash64("signature"))
    return hashed.join(starts, ["k", "h"]).where(F.col("longer") >= OFTENER * F.col("n")).select("signature", F.lit(True).alias("cut_signature"))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, source, truncated, reason) of each text that is not blank."""
    e = checkpointed(endings(docs)).withColumn("key", F.coalesce("source", F.lit("\0none")))
    e = (e.join(limits(e), ["key", "n_chars", "how"], "left").join(baselines(e), "key", "left").join(harmless(e), "key", "left")
         .join(cut_signatures(e), "signature", "left"))
    how = F.col("how")
    stack = F.size(F.array_except("open", F.coalesce("harmless", F.array().cast("array<string>")))) > 0
    reason = (F.when(how == "broken", "broken")
              .when(stack & ~how.isin("ellipsis", "dots", "signature"), "open")
              .when(how.isin("ellipsis", "dots") & F.coalesce("at_limit", F.lit(False)), "limit")
              .when((how == "title") & ~F.coalesce("titled_source", F.lit(False)), "title")
              .when((how == "signature") & F.coalesce("cut_signature", F.lit(False)), "signature")
              .when((how == "bare") & ~F.coalesce("bare_source", F.lit(False)), "terminator"))
    return e.select("doc_id", "source", reason.isNotNull().alias("truncated"), reason.alias("reason"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "source", "text")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_docs(spark, sf_dir)).where("truncated").select("doc_id")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates, and by what it shows."""
    reasons = [F.count_if(F.col("reason") == r).alias(f"by_{r}") for r in ("broken", "open", "limit", "title", "signature", "terminator")]
    return judged(_docs(spark, sf_dir)).groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if("truncated").alias("truncated"), *reasons).withColumn("share", F.round(F.col("truncated") / F.col("texts"), 4))
