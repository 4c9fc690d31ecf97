"""Secret scans with built-in functions only.

Three fixed patterns give the base findings.  Besides, every long run of key
characters is a candidate: a window slides over it, the window's counts of
characters change by the one that enters and the one that leaves, and the
Shannon entropy follows from the running sum of c*log2(c).  A candidate whose
best window passes the threshold of its character class is a finding of kind
``entropy`` unless the allow-list knows its shape or a base finding covers it.

Defined results: null text counts as empty; a text without findings has zero
counts, an empty ``spans`` string and the hash of the empty string; equal rows
give equal rows; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import joined, kinded, let, match_spans

# The patterns of the contract.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}


@dataclass(frozen=True)
class EntropyClass:
    """Candidates that are made of ``pattern`` alone use this window and threshold."""

    pattern: str
    alphabet: str
    window: int
    bits: float


#: From the narrowest class to the widest; the first that fits a candidate counts.
CLASSES = (
    EntropyClass(r"^[0-9A-Fa-f]+$", "0123456789abcdef", 20, 2.8),
    EntropyClass(r"^[0-9A-Za-z]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 20, 3.5),
    EntropyClass(
        r"^[0-9A-Za-z+/_=-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 20, 3.6
    ),
)
CANDIDATE = r"[0-9A-Za-z+/_=-]{20,}"
#: Shapes that are never secrets: numbers alone, letters alone, dashed words, UUIDs, placeholders, runs of one alphabet.
ALLOW = (
    r"^[0-9_+/=-]+$",
    r"^[A-Za-z_+/=-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)(example|sample|placeholder|dummy|redacted|changeme|your[_-]?(api|key|token)|x{6,}|0{8,})",
    r"(?i)(abcdefghij|0123456789|qwertyuiop)",
)


def best_entropy(candidate: Column, cls: EntropyClass) -> Column:
    """Largest Shannon entropy in bits of any ``cls.window`` successive characters."""
    size, base = cls.window, F.lower(candidate) if cls.alphabet == CLASSES[0].alphabet else candidate
    clog = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    start = F.struct(
        F.array_repeat(F.lit(0), len(cls.alphabet) + 1).alias("counts"),
        F.lit(0.0).alias("s"),
        F.lit(-1.0).alias("best"),
    )

    def over(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            come, go = F.get(codes, i), F.when(i >= size, F.get(codes, i - size)).otherwise(F.lit(-1))

            def move(x: Column) -> Column:
                enter, leave = x["come"], x["go"]
                c_in, c_out = F.get(a["counts"], enter), F.get(a["counts"], leave)
                # one that enters as its like leaves changes nothing
                s = (
                    F.when(enter == leave, a["s"])
                    .when(leave < 0, a["s"] + clog(c_in + 1) - clog(c_in))
                    .otherwise(a["s"] + clog(c_in + 1) - clog(c_in) + clog(c_out - 1) - clog(c_out))
                )
                counts = F.transform(
                    a["counts"],
                    lambda c, j: c + F.when(j == enter, 1).otherwise(0) - F.when(j == leave, 1).otherwise(0),
                )
                return let(
                    s,
                    lambda v: F.struct(
                        counts.alias("counts"),
                        v.alias("s"),
                        F.when(i >= size - 1, F.greatest(a["best"], F.log2(F.lit(float(size))) - v / size))
                        .otherwise(a["best"])
                        .alias("best"),
                    ),
                )

            return let(F.struct(come.alias("come"), go.alias("go")), move)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["best"])

    codes = F.transform(F.split(base, ""), lambda ch: F.instr(F.lit(cls.alphabet), ch))
    return let(F.filter(codes, lambda c: c > 0), over)


def passes(candidate: Column) -> Column:
    """Whether a candidate is a finding: not allow-listed, and above its class's threshold."""
    high = F.lit(False)
    for cls in reversed(CLASSES):
        high = F.when(candidate.rlike(cls.pattern), best_entropy(candidate, cls) >= cls.bits).otherwise(high)
    allowed = F.lit(False)
    for shape in ALLOW:
        allowed = allowed | candidate.rlike(shape)
    return F.when(allowed, F.lit(False)).otherwise(high)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, then arrays of spans: ``base`` and ``added``, each sorted by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col),
        match_spans(text, ASSIGN, lambda m, g: F.length(g) >= LEAST["assign"], group=2).alias("assign"),
        match_spans(text, r"AKIA[A-Z0-9]{14,}", lambda m, g: F.lit(True)).alias("access"),
        match_spans(text, r"[0-9a-f]{16,}", lambda m, g: F.lit(True)).alias("hex"),
        match_spans(text, CANDIDATE, lambda m, g: passes(m)).alias("entropy"),
    )
    base = F.sort_array(
        F.concat(*(kinded(F.col(kind), kind, rank) for rank, kind in enumerate(("assign", "access", "hex"))))
    )
    found = found.select(id_col, "assign", "access", "hex", "entropy", base.alias("base"))
    alone = F.when(
        F.size("entropy") > 0,
        F.filter(
            "entropy",
            lambda e: ~F.exists(F.col("base"), lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])),
        ),
    ).otherwise(F.col("entropy"))
    return found.select(
        id_col,
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        "base",
        kinded(alone, "entropy", 3).alias("added"),
    )


def op2_secret_scan(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_entropy"),
    )
