"""Secret scan by a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams that any match must hold (see trigrams). The postings of the mandatory trigrams are kept
vertically, as one bit per trigram beside each document, so intersecting postings is a bitwise AND and moves no rows.
Candidates are verified by the regular expression itself. A rule without mandatory trigrams scans every text.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .spans import match_spans, no_spans, redacted, spelled
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """group: what `least` measures in code points; matches of fewer are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Fixed values of the result contract: the three base rules, in the listed order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
)
#: A private key goes up to its END line; where that is missing, through header lines and base64: long runs, or whole lines.
#: Line ends may be spelled \n, as in quoted strings. Possessive, so that long keys need no deep stack.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:\s|\\[rn])++(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+"
    r"(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{20,}+|\x20*+(?:[\r\n]|\\[rn])(?:\s|\\[rn])*+[A-Za-z0-9+/=]++(?!\x20*+[^\r\n\\\x20]))*+)"
)
#: What this scan adds: public token formats.
MORE_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:authorization:\x20*bearer)\x20+[A-Za-z0-9._~+/=-]{16,}"),
)


def indexed_trigrams(rules) -> list[str]:
    """The trigrams that the rules' queries ask for, in order."""
    return sorted({t for r in rules for option in trigram_query(r.pattern) for t in option})


def postings(low: Column, grams: list[str]) -> list[Column]:
    """The vertical postings: 62 trigrams to a long, a bit for each that the text holds."""
    words = [grams[i : i + 62] for i in range(0, len(grams), 62)]
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains(low, F.lit(g)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, g in enumerate(w)]) for w in words]


def _candidate(rule: Rule, grams: list[str], posting: list[Column]) -> Column:
    options = sorted(map(sorted, trigram_query(rule.pattern)))
    if not all(options):
        return F.lit(True)

    def holds(option):
        masks = [sum(1 << (grams.index(g) % 62) for g in option if grams.index(g) // 62 == k) for k in range(len(posting))]
        return reduce(lambda a, b: a & b, [p.bitwiseAND(F.lit(m)) == F.lit(m) for p, m in zip(posting, masks) if m])

    return reduce(lambda a, b: a | b, [holds(o) for o in options])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_rules=MORE_RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the kept columns (prefixed _keep_), _text, base_spans and spans (arrays of start, kind_at, stop, kind).

    Null text counts as empty and has no spans; repeated rows are each scanned; null ids stay null; other columns of
    the input don't matter. more_rules may be any rules; base ones are always applied.
    """
    rules = [*BASE_RULES, *more_rules]
    grams = indexed_trigrams(rules)
    df = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"), *[F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep])
    n = (len(grams) + 61) // 62
    # contains() on the bytes of the lower-cased text; the lower case lives for this projection only
    df = df.withColumn("_low", F.lower("_text"))
    df = df.withColumns({f"_p{k}": p for k, p in enumerate(postings(F.col("_low"), grams))}).drop("_low")
    posting = [F.col(f"_p{k}") for k in range(n)]
    found = {}
    for at, r in enumerate(rules):
        passes = (lambda v, least=r.least: F.length(v) >= least) if r.least else None
        # a necessary test, so that the aggregate runs on few rows: a run of the least length
        pre = _candidate(r, grams, posting)
        if r.kind == "hex":
            pre = F.col("_text").rlike("[0-9a-f]{32}")
        found[f"_s{at}"] = F.when(pre, match_spans(F.col("_text"), r.pattern, r.kind, at, passes, r.group)).otherwise(no_spans())
    df = df.withColumns(found)
    base = F.concat(*[F.col(f"_s{at}") for at, r in enumerate(rules) if r.base])
    every = F.concat(*[F.col(f"_s{at}") for at in range(len(rules))])
    counts = {f"n_{r.kind}": F.size(f"_s{at}").cast("long") for at, r in enumerate(BASE_RULES)}
    return df.select(F.col("_id").alias(id_col), *[F.col(f"`_keep_{c}`") for c in keep], F.col("_text"), *[c.alias(k) for k, c in counts.items()], base.alias("base_spans"), every.alias("spans"))


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scan's results with spans spelled out, and the base ones hashed; nulls, empties and repeats as in scan_secrets."""
    found = scan_secrets(docs, id_col, text_col)
    return found.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret replaced by a mark; null texts stay null, clean texts stay as they are."""
    others = [c for c in docs.columns if c != id_col]
    found = scan_secrets(docs, id_col, text_col, keep=tuple(others))
    clean = F.when(F.size("spans") == 0, F.col(f"_keep_{text_col}")).otherwise(redacted(F.col("_text"), F.col("spans")))
    column = {id_col: F.col(id_col), text_col: clean}
    return found.select(*[column.get(c, F.col(f"`_keep_{c}`")).alias(c) for c in docs.columns])
