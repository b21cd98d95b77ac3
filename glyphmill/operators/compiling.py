"""The boundary to a compiler from TeX to Office Math: each distinct formula once per corpus, in batches with deadlines.

A compiler is a function of a list of formulas that returns markup by formula; what it leaves out has failed.  Every batch runs in a
child process of its own that is stopped, with its children, when its time is over, so a compiler that hangs costs one batch.  A batch
that fails as a whole is halved until the formulas at fault stand alone; after a batch that hangs, the task tries no others.  Formulas
are dealt out by hash to tasks of ``TASK_SLICES`` times ``TASK_FORMULAS``, and the total time holds for one slice of ``TASK_FORMULAS``.
"""

from __future__ import annotations

import multiprocessing
import os
import signal
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import strip
from glyphmill.operators.graph import dealt

Compiler = Callable[[list[str]], dict[str, bytes]]
#: Formulas of a batch, seconds of a batch and of all batches of a task.
BATCH, BATCH_SECONDS, TOTAL_SECONDS = 200, 30.0, 45.0
TASK_FORMULAS, TASK_SLICES = 2000, 5


class Failed(RuntimeError):
    """A batch that the compiler did not survive."""


def one_by_one(compiler: Callable[[str], bytes]) -> Compiler:
    """A compiler of batches from one of single formulas; a formula that raises is left out."""

    def run(formulas: list[str]) -> dict[str, bytes]:
        out = {}
        for f in formulas:
            try:
                out[f] = compiler(f)
            except Exception:  # noqa: BLE001  one formula's fault
                continue
        return out

    return run


def bounded(compiler: Compiler, formulas: list[str], seconds: float) -> dict[str, bytes]:
    """What the compiler returns, from a child process; TimeoutError when its time is over, Failed when it raises, ends or returns no mapping."""
    context = multiprocessing.get_context("fork")
    ours, theirs = context.Pipe(duplex=False)

    def work() -> None:
        os.setsid()
        ours.close()
        try:
            theirs.send((True, {str(k): bytes(v) for k, v in compiler(formulas).items()}))
        except BaseException as e:  # noqa: BLE001  whatever ends it is told
            theirs.send((False, f"{type(e).__name__}: {e}"))
        theirs.close()

    child = context.Process(target=work, daemon=True)
    child.start()
    theirs.close()
    try:
        if not ours.poll(max(0.1, seconds)):
            raise TimeoutError(f"the compiler exceeded {seconds:g} seconds and was stopped")
        good, value = ours.recv()
    except EOFError:
        raise Failed("the compiler ended without a result") from None
    finally:
        try:
            os.killpg(child.pid, signal.SIGKILL)
        except (ProcessLookupError, PermissionError):
            child.kill()
        child.join()
        ours.close()
    if not good:
        raise Failed(value)
    return value


def compile_all(compiler: Compiler, formulas: list[str], batch: int = BATCH, seconds: float = BATCH_SECONDS, total: float = TOTAL_SECONDS, clock: Callable[[], float] = time.monotonic) -> Iterator[tuple[str, bytes | None, str | None, str | None]]:
    """(formula, markup, code, message) of each formula, batch by batch."""
    begun = clock()
    todo = [formulas[at : at + batch] for at in range(0, len(formulas), batch)]
    stop: tuple[str, str] | None = None
    while todo:
        own = todo.pop(0)
        left = total - (clock() - begun)
        if stop is None and left <= 0:
            stop = ("PANDOC_TOTAL_TIMEOUT", f"the compiler reached the total limit of {total:g} seconds")
        if stop:
            yield from ((f, None, *stop) for f in own)
            continue
        try:
            made = bounded(compiler, own, min(seconds, left))
        except TimeoutError as e:
            stop = ("PANDOC_TIMEOUT", str(e))
            yield from ((f, None, *stop) for f in own)
            continue
        except Failed as e:
            if len(own) > 1:
                todo[:0] = [own[: len(own) // 2], own[len(own) // 2 :]]
            else:
                yield own[0], None, "PANDOC_BATCH_FAILED", str(e)
            continue
        for f in own:
            yield (f, made[f], None, None) if f in made else (f, None, "PANDOC_FORMULA_FAILED", "the compiler could not convert this formula to native Office Math")


SCHEMA = pa.schema([("normalized", pa.string()), ("markup", pa.binary()), ("code", pa.string()), ("message", pa.string())])


def compiled(formulas: DataFrame, compiler: Compiler, batch: int = BATCH, seconds: float = BATCH_SECONDS, total: float = TOTAL_SECONDS) -> DataFrame:
    """formulas (normalized) -> (normalized, markup, code, message), one row for each distinct formula, stripped; markup is null where a code says why.

    Rows come as they are computed, so a caller that uses them twice should write them first.
    """
    distinct = formulas.select(strip(F.col("normalized")).alias("normalized")).where("normalized is not null").distinct()
    distinct = dealt(distinct, TASK_SLICES * TASK_FORMULAS, "normalized")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [f for b in batches for f in b.column(0).to_pylist()]
        for at in range(0, len(own), TASK_FORMULAS):
            rows = list(compile_all(compiler, own[at : at + TASK_FORMULAS], batch, seconds, total))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    return distinct.mapInArrow(run, "normalized string, markup binary, code string, message string")


def warnings(items: DataFrame, made: DataFrame) -> DataFrame:
    """items (doc, part, paragraph_index, normalized), made of ``compiled`` -> (doc, part, paragraph_index, code, message, formula): a row for each place of a formula that failed."""
    failed = made.where("markup is null").select(F.col("normalized").alias("formula"), "code", "message")
    return items.withColumn("formula", strip(F.col("normalized"))).join(failed, "formula").select("doc", "part", "paragraph_index", "code", "message", "formula")
