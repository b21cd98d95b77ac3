"""Formula detection as column expressions: score, damage test, candidate spans, greedy packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import leading, let, matches, strip

#: Delimiters in order of priority, with kind, display and confidence.
EXPLICIT = (
    (r"(?s)\$\$(.+?)\$\$", "latex-display", True, 0.99),
    (r"(?s)\\\[(.+?)\\\]", "latex-display", True, 0.99),
    (r"(?s)\\\((.+?)\\\)", "latex-inline", False, 0.99),
    (r"(?s)(?<!\\)(?<!\$)\$(?!\$)(.+?)(?<!\\)\$(?!\$)", "latex-inline", False, 0.98),
)
ENVIRONMENT = (r"(?s)\\begin\{(?<name>[A-Za-z*]+)\}.*?\\end\{\k<name>\}", "latex-environment", True, 0.96)
#: Commands that count, symbols, words, right-to-left script, plain equations.
COMMANDS = (
    "frac", "dfrac", "tfrac", "sqrt", "sum", "prod", "int", "lim", "begin", "matrix", "vec", "hat", "widehat", "bar", "overline", "underline",
    "alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "rho", "sigma", "phi", "chi", "omega", "text", "mathrm", "mathbf", "mathbb", "left", "right",
)
COMMAND = r"(?U)\\(?:" + "|".join(COMMANDS) + r")\b"
SYMBOL = "[=<>≤≥≠≈±×÷∑∏∫√∞→←↔∂∇^_⁰¹²³⁴-⁹₀-₉α-ωΑ-Ω]"
DIGIT = r"(?U)\d"
WORD = r"[A-Za-z\u0600-\u06ff]{3,}"
PERSIAN = r"[\u0600-\u06ff]"
NAME_TAIL = "A-Za-z0-9_₀-₉⁰¹²³⁴-⁹"
EQUATION = rf"(?dU)^\s*(?:[A-Za-zα-ωΑ-Ω][{NAME_TAIL}]*(?:\s*\([^)]{{0,80}}\))?|[{NAME_TAIL}()]+)\s*(?:=|≈|≤|≥|≠|:=|→)\s*.+$"
MODES = ("safe", "balanced", "aggressive")

SPAN = "struct<start:int,end:int,kind:string,display:boolean,confidence:double>"


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def unescaped_dollars(text: Column) -> Column:
    return _n(text, r"(?<!\\)\$")


def _score(t: Column) -> Column:
    """Score of a text without white space at its ends."""
    score = _n(t, COMMAND) * F.lit(3.5) + _n(t, SYMBOL) * F.lit(1.2) + F.least(_n(t, DIGIT), F.lit(8)) * F.lit(0.15)
    score = score - F.greatest(F.lit(0), _n(t, WORD) - 3) * F.lit(0.7)
    score = score + F.when(_has(t, EQUATION), F.lit(3.0)).otherwise(F.lit(0.0))
    score = score - F.when(_has(t, PERSIAN) & (F.length(t) > 80), F.lit(3.0)).otherwise(F.lit(0.0))
    return F.when(t == "", F.lit(0.0)).otherwise(score)


def math_score(text: Column) -> Column:
    """How much a text looks like mathematics; blank: 0."""
    return let(strip(text), _score)


def _broken(t: Column, score: Column) -> Column:
    displays = _n(t, r"(?<!\\)\$\$")
    proper = (displays == 2) & t.startswith("$$") & t.endswith("$$")
    stray = (displays > 0) & ~proper & (score >= 2.0)
    odd = (unescaped_dollars(t) % 2 == 1) & (score >= 4.0) & (_n(t, WORD) <= 3)
    nameless = (t.contains("\\begin{}") | t.contains("\\end{}")) & (score >= 3.0)
    return stray | odd | nameless


def is_broken(text: Column) -> Column:
    """A paragraph that is one damaged formula."""
    return let(strip(text), lambda t: let(_score(t), lambda score: _broken(t, score)))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def packed(spans: Column) -> Column:
    """Keeps each span that overlaps no earlier one; spans come in order of priority."""
    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), lambda acc, c: F.when(F.exists(acc, lambda x: overlap(x, c)), acc).otherwise(F.concat(acc, F.array(c))))


def _span(start, end, kind: str, display, confidence) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), lit(display).alias("display"), lit(confidence).cast("double").alias("confidence"))


def _found(text: Column, pattern: str, kind: str, display: bool, confidence: float) -> Column:
    return F.transform(matches(text, pattern, 0), lambda m: _span(m["start"], m["end"], kind, display, confidence))


def explicit_spans(text: Column, mode: str) -> Column:
    patterns = EXPLICIT if mode == "safe" else (*EXPLICIT, ENVIRONMENT)
    return packed(F.flatten(F.array(*(_found(text, *p) for p in patterns))))


def candidate_spans(text: Column, mode: str = "balanced") -> Column:
    """Array of candidate spans of a paragraph, by start and end; null text: empty."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    text = F.coalesce(text, F.lit(""))
    nothing = F.array().cast(f"array<{SPAN}>")
    if mode == "safe":
        return F.when(strip(text) == "", nothing).otherwise(F.array_sort(explicit_spans(text, mode)))

    def rest(t: Column, score: Column, found: Column, start: Column) -> Column:
        size = F.length(t)
        end, long = start + size, size > 24
        free = ~F.exists(found, lambda s: (s["start"] < end) & (start < s["end"]))
        raw = F.when(_has(t, COMMAND) & (score >= 4.0), _span(start, end, "latex-raw", long | t.contains("="), F.least(F.lit(0.94), F.lit(0.76) + score / 50)))
        plain = raw.when(_has(t, EQUATION) & (score >= 4.0), _span(start, end, "plain-equation", long, F.least(F.lit(0.91), F.lit(0.72) + score / 45)))
        if mode == "balanced":
            fits, sure = (score >= 4.5) & (_n(t, WORD) <= 2) & (size <= 160), F.least(F.lit(0.90), F.lit(0.74) + score / 55)
        else:
            fits, sure = (score >= 3.5) & (size <= 240), F.least(F.lit(0.86), F.lit(0.67) + score / 55)
        whole = plain.when(_has(t, SYMBOL) & fits, _span(start, end, "unicode-math", long, sure))
        broken = F.array(_span(start, end, "latex-broken", True, 0.92))
        return F.when(_broken(t, score), broken).otherwise(F.array_sort(F.concat(found, F.array_compact(F.array(F.when(free, whole))))))

    inner = let(strip(text), lambda t: let(_score(t), lambda score: let(explicit_spans(text, mode), lambda found: let(leading(text), lambda start: rest(t, score, found, start)))))
    return F.when(strip(text) == "", nothing).otherwise(inner)
