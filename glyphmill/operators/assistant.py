"""Diagnostics by a language model: prompts of units, and findings in the responses of three kinds of service.

No service is called from here: a caller's function answers prompts, or responses are rows already.  Responses are parsed as VARIANT by
expressions.  A service that failed, an envelope that lacks its field and an answer that is no list of findings are rows of AI_UNAVAILABLE;
others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import let, strip

#: Characters of a source that are sent, kinds of envelopes, what stands in for missing fields.
MOST_SOURCE = 120_000
OPENAI, COMPATIBLE, OLLAMA = "openai", "openai-compatible", "ollama"
DEFAULTS = {"title": "AI finding", "explanation": "", "suggestion": "", "severity": "warning"}
INSTRUCTIONS = (
    "Act as a conservative LaTeX diagnostics assistant. Answer with JSON only: an array of objects with the fields title, explanation, suggestion, severity "
    "and, where known, line. Leave prose as it is. Report problems of compilation, packages, references, fonts, bidirectional text and formulas.\n\n"
)
INVALID = "The AI response was not valid structured JSON."


def prompts(units: DataFrame) -> DataFrame:
    """units (project, file, text) -> (project, file, prompt); of a source the first MOST_SOURCE characters are sent."""
    return units.select("project", "file", F.concat(F.lit(INSTRUCTIONS), F.substring("text", 1, MOST_SOURCE)).alias("prompt"))


def answered(asked: DataFrame, provider: str, complete: Callable[[str], str]) -> DataFrame:
    """prompts() -> responses (project, file, provider, body, error); complete returns a response's body.  A call that raises is an error of its row."""
    schema = pa.schema([("project", pa.string()), ("file", pa.string()), ("provider", pa.string()), ("body", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    body, error = complete(r["prompt"]), None
                except Exception as e:  # noqa: BLE001  one call's fault
                    body, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"project": r["project"], "file": r["file"], "provider": provider, "body": body, "error": error}], schema=schema)

    return asked.select("project", "file", "prompt").mapInArrow(run, "project string, file string, provider string, body string, error string")


def parsed(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as VARIANT; null for any other.

    The parser stops behind the first value.  What follows it would have to close a list when the text is put in brackets, and an object
    when it is put in braces, so only a text that ends there passes both.
    """

    def alone(t: Column) -> Column:
        values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$", "array<variant>")
        return let(values, lambda v: F.when((F.size(v) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))).isNotNull(), F.get(v, F.lit(0))))

    return let(text, alone)


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    """A value as text: strings as they are, None, True and False by these names, all else as JSON."""
    plain = v.cast("string")
    return F.when(F.is_variant_null(v), "None").when(_is(v, "BOOLEAN"), F.initcap(plain)).when(_is(v, "OBJECT") | _is(v, "ARRAY"), F.to_json(v)).otherwise(plain)


def _items(v: Column) -> Column:
    """The values of a list; none if it is no list."""
    return F.when(_is(v, "ARRAY"), v.cast("array<variant>")).otherwise(F.array().cast("array<variant>"))


def _answer(v: Column, kind: Column, failed: Column) -> Column:
    """(answer, error) of a parsed response; each part of it is bound once."""
    contents = F.flatten(F.transform(F.filter(_items(_at(v, "$.output")), lambda x: _is(x, "OBJECT")), lambda x: _items(_at(x, "$.content"))))
    chunks = F.filter(F.transform(contents, lambda c: _at(c, "$.text")), lambda t: _is(t, "STRING"))
    joined = F.array_join(F.transform(chunks, lambda t: t.cast("string")), "\n")
    openai = let(_at(v, "$.output_text"), lambda whole: F.when(_is(whole, "STRING"), whole.cast("string")).otherwise(joined))
    compatible = let(_at(v, "$.choices[0].message.content"), lambda c: F.when(c.isNotNull(), _text(c)))
    ollama = let(_at(v, "$.response"), lambda r: F.when(_is(r, "STRING"), r.cast("string")))
    answer = F.when(kind == OPENAI, openai).when(kind == COMPATIBLE, compatible).when(kind == OLLAMA, ollama)
    why = (
        F.when(failed.isNotNull(), F.concat(F.lit("AI provider request failed: "), failed)).when(v.isNull(), F.lit("AI provider request failed: the response is no JSON"))
        .when(~_is(v, "OBJECT"), F.lit("AI provider returned a non-object JSON response."))
    )
    lacking = (
        F.when(kind == COMPATIBLE, "Compatible provider response is missing choices[0].message.content.").when(kind == OLLAMA, "Ollama response is missing the response field.")
        .otherwise(F.concat(F.lit("Unknown AI provider: "), F.coalesce(kind, F.lit(""))))
    )
    return let(F.when(why.isNull(), answer), lambda a: F.struct(a.alias("answer"), F.coalesce(why, F.when(a.isNull(), lacking)).alias("error")))


def completions(responses: DataFrame) -> DataFrame:
    """responses (project, file, provider, body, error) -> (project, file, answer, error): the text within the envelope, or why there is none."""
    found = let(parsed(F.col("body")), lambda v: _answer(v, F.col("provider"), F.col("error")))
    return responses.select("project", "file", found.alias("r")).select("project", "file", "r.answer", "r.error")


def _line(x: Column) -> Column:
    """(line, bad) of a finding: a whole number, also as text; bad if it is anything else but missing."""
    def read(v: Column) -> Column:
        text = strip(v.cast("string"))
        whole = (
            F.when(_is(v, "STRING"), F.when(F.regexp_like(text, F.lit("^[+-]?[0-9]+$")), text.try_cast("bigint"))).when(_is(v, "BOOLEAN"), _at(v, "$", "boolean").cast("bigint"))
            .when(_is(v, "BIGINT") | _is(v, "DECIMAL") | _is(v, "DOUBLE"), _at(v, "$", "double").try_cast("bigint"))
        )
        there = v.isNotNull() & ~F.is_variant_null(v)
        return let(F.when(there, whole), lambda n: F.struct(n.cast("int").alias("line"), (there & n.isNull()).alias("bad")))

    return let(_at(x, "$.line"), read)


def _read(answer: Column) -> Column:
    """(good, found) of an answer: whether it is a list of findings, and they."""
    def made(v: Column) -> Column:
        field = lambda x, name: F.coalesce(_text(_at(x, f"$.{name}")), F.lit(DEFAULTS[name])).alias(name)
        objects = F.filter(_items(v), lambda x: _is(x, "OBJECT"))
        rows = F.transform(objects, lambda x: F.struct(*(field(x, n) for n in DEFAULTS), _line(x).alias("at")))
        return let(rows, lambda f: F.struct((_is(v, "ARRAY") & ~F.exists(f, lambda r: r["at"]["bad"])).alias("good"), f.alias("found")))

    def bare(raw: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(raw, r"(?s)^[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
        return F.when(raw.startswith("```"), strip(inner)).otherwise(raw)

    return let(parsed(let(strip(answer), bare)), made)


def findings(answers: DataFrame) -> DataFrame:
    """completions() -> (project, file, pos, code, title, explanation, suggestion, severity, line, message).

    An answer may stand in a fenced block.  It is refused as a whole if it is no list, or if a line is no whole number.
    """
    rows = answers.select("project", "file", "error", _read(F.col("answer")).alias("r"))
    nothing = F.struct(*(F.lit(None).cast("string").alias(n) for n in DEFAULTS), F.struct(F.lit(None).cast("int").alias("line"), F.lit(False).alias("bad")).alias("at"))
    message = F.when(F.col("error").isNotNull(), F.concat(F.lit("AI analysis failed: "), "error")).when(~F.coalesce("r.good", F.lit(False)), F.lit(INVALID))
    rows = rows.select("project", "file", message.alias("message"), "r")
    each = rows.select("project", "file", "message", F.posexplode(F.when(F.col("message").isNull(), F.col("r.found")).otherwise(F.array(nothing))).alias("pos", "f"))
    code = F.when(F.col("message").isNull(), "AI_FINDING").otherwise("AI_UNAVAILABLE")
    return each.select("project", "file", "pos", code.alias("code"), *(f"f.{n}" for n in DEFAULTS), "f.at.line", "message")
