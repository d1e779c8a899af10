"""Engines: batch functions over texts, with retry, fallback and a log of every call.

An engine is plugged in by ``register``; ``adapters`` registers those that need a network,
a process or a package.  What is not there says so in ``check`` and is listed as
unavailable.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..functions.constants import SEGMENT_FRAME


class EngineError(Exception):
    """Worth another try."""


class RateLimited(EngineError):
    """Worth another try after a long pause."""


class EngineUnavailable(EngineError):
    """Not worth another try."""


class EmptyOutput(EngineError):
    """The next model may do better."""


@dataclass
class Engine:
    name: str
    translate: Callable[[list[str]], list[str]]
    description: str = ""
    is_llm: bool = False
    supports_tags: bool = True
    max_chars: int = 4500
    check: Callable[[], None] = field(default=lambda: None)
    complete: Callable[[str, str], str] | None = None  # of an LLM: (system, user) to its answer
    model: str | None = None


REGISTRY: dict[str, Callable[..., Engine]] = {}
#: Engines whose makers take the languages.
OF_LANGUAGES: set[str] = set()


def register(name: str, make: Callable[..., Engine], languages: bool = False) -> None:
    REGISTRY[name.lower()] = make
    (OF_LANGUAGES.add if languages else OF_LANGUAGES.discard)(name.lower())


def maker(name: str, src: str = "en", tgt: str = "tr") -> Callable[[], Engine]:
    """What makes the engine; it travels to the executors, where clients are then made."""
    from . import adapters  # noqa: F401 - registers its engines

    try:
        found = REGISTRY[name.lower()]
    except KeyError:
        raise SystemExit(f"unknown engine {name!r}; known: {', '.join(sorted(REGISTRY))}") from None
    return partial(found, src, tgt) if name.lower() in OF_LANGUAGES else found


def make(name: str, src: str = "en", tgt: str = "tr") -> Engine:
    return maker(name, src, tgt)()


register("echo", lambda: Engine("echo", list, "gives every text back"))
register("upper", lambda: Engine("upper", lambda texts: [_upper(t) for t in texts], "upper case outside of tags", max_chars=200))


def _upper(text: str) -> str:
    return "".join(p if p.startswith("<") else p.upper() for p in re.split(r"(<[^>]*>)", text))


def availability(spark: SparkSession) -> DataFrame:
    """engine, description and status of all engines but echo."""
    from . import adapters  # noqa: F401 - registers its engines

    rows = []
    for name in sorted(REGISTRY):
        if name == "echo":
            continue
        e = make(name)
        try:
            e.check()
            status = "ok"
        except EngineUnavailable as x:
            status = f"unavailable: {x}"
        except Exception as x:  # noqa: BLE001 - a listing must not end at a broken engine
            status = f"error: {x}"
        rows.append((name, e.description, status))
    return spark.createDataFrame(rows, "engine string, description string, status string")


def attempts(name: str, ask: Callable[[], object], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[object | None, list[dict]]:
    """What ``ask`` gives, or None after the last failure, and a row for each attempt."""
    log: list[dict] = []
    for attempt in range(retries):
        began = time.monotonic()
        row = {"engine": name, "attempt": attempt, "ok": True, "error_class": None, "seconds": 0.0}
        result, limited, gone = None, False, False
        try:
            result = ask()
        except Exception as x:  # noqa: BLE001 - whatever an engine raises counts as its failure
            row |= {"ok": False, "error_class": type(x).__name__ if isinstance(x, EngineError) else "EngineError"}
            limited = isinstance(x, RateLimited)
            gone = isinstance(x, EngineUnavailable)
        row["seconds"] = time.monotonic() - began
        log.append(row)
        if result is not None:
            return result, log
        if gone:
            break
        if attempt < retries - 1:
            sleep(min(90, 15 * 2**attempt) if limited else 2 * 2**attempt)
    return None, log


def call(engine: Engine, texts: list[str], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str] | None, list[dict]]:
    """Results, or None after the last failure, and a row for each attempt."""

    def ask():
        result = engine.translate(texts)
        if len(result) != len(texts):
            raise EngineError(f"{len(result)} results for {len(texts)} texts")
        return result

    return attempts(engine.name, ask, retries, sleep)


def through_chain(engines: list[Engine], texts: list[str], retries: int = 3, sleep: Callable[[float], None] = time.sleep, plain: list[str] | None = None) -> tuple[list[tuple[str | None, str | None]], list[dict]]:
    """(result, engine) of every text: engines in order, each for what is still missing; and the log.

    Each engine that keeps no tags gets the ``plain`` text instead, whatever the others get.
    """
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)
    log: list[dict] = []
    for e in engines:
        todo = [k for k, (r, _) in enumerate(out) if not r]
        if not todo:
            break
        own = texts if e.supports_tags or plain is None else plain
        result, rows = call(e, [own[k] for k in todo], retries, sleep)
        log += rows
        for k, r in zip(todo, result or []):
            if r:
                out[k] = (r, e.name)
    return out, log


_FRAME = re.compile(SEGMENT_FRAME)


def ask_in_frames(complete: Callable[[str, str], str], system: str, texts: list[str], ask: str = "Translate these segments.", rounds: int = 3) -> list[str | None]:
    """Texts as numbered segments of one request; those missing in the answer are asked for again, up to ``rounds`` requests in all.

    Of an id that comes twice the last text counts, unknown ids are ignored, empty texts are missing.
    """
    out: list[str | None] = [None] * len(texts)
    for _ in range(rounds):
        todo = [k for k, r in enumerate(out) if not r]
        if not todo:
            break
        frames = "\n".join(f'<seg id="{n}">{texts[k]}</seg>' for n, k in enumerate(todo, 1))
        answer = {int(i): t.strip() for i, t in _FRAME.findall(complete(system, f"{ask}\n\n{frames}"))}
        for n, k in enumerate(todo, 1):
            out[k] = answer.get(n) or None
    if not any(out) and texts:
        raise EmptyOutput("no segment came back")
    return out


def from_completion(name: str, complete: Callable[[str, str], str], system: str = "") -> Engine:
    """An LLM engine over a chat function."""
    return Engine(name, lambda texts: ask_in_frames(complete, system, texts), is_llm=True, complete=complete)


def with_models(models: list[str], complete: Callable[[str, str, str], str]) -> Callable[[str, str], str]:
    """Tries models in order and stays with the first that works."""
    at = [0]

    def call_(system: str, user: str) -> str:
        last: Exception = EngineError("no model is named")
        for k in range(at[0], len(models)):
            try:
                answer = complete(models[k], system, user)
                if not answer.strip():
                    raise EmptyOutput(models[k])
                at[0] = k
                return answer
            except (EmptyOutput, RateLimited) as x:
                last = x
        raise last

    return call_


def split_bytes(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` bytes: sentences, then words, then characters, put together greedily with spaces."""
    atoms: list[str] = []
    for s in re.split(r"(?<=[.!?;])\s+", text):
        for w in [s] if len(s.encode()) <= limit else s.split():
            while len(w.encode()) > limit:
                n = len(w.encode()[:limit].decode("utf-8", "ignore"))
                atoms.append(w[:n])
                w = w[n:]
            atoms.append(w)
    out: list[str] = []
    for a in filter(None, atoms):
        if out and len(f"{out[-1]} {a}".encode()) <= limit:
            out[-1] += " " + a
        else:
            out.append(a)
    return out


def bounded(one: Callable[[str], str], limit: int) -> Callable[[list[str]], list[str]]:
    """A batch function over a service that takes texts of so many bytes."""
    return lambda texts: [" ".join(one(p) for p in split_bytes(t, limit)) for t in texts]


def first_instance(instances: list[Callable[[str], str]]) -> Callable[[list[str]], list[str]]:
    """Tries instances in order; one that gives the text back has failed."""

    def each(text: str) -> str:
        for f in instances:
            try:
                r = f(text)
            except Exception:  # noqa: BLE001 - the next instance may do
                continue
            if r and r != text:
                return r
        raise EngineError("no instance answered")

    return lambda texts: [each(t) for t in texts]


def setting(conf, name: str, *fallbacks: str | None) -> str | None:
    """A Spark setting; an empty one counts as not set, then the first fallback that is not empty."""
    return next((x for x in (conf.get(name, None), *fallbacks) if x), None)
