"""Generation of text over rows by an injected generator: turns, retries, validation, refusals, fallbacks.

A generator is a picklable callable (prompt, history) -> reply. The engine brings none but ``echo``, which is
deterministic; it talks to no network and has no prompts of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import budget
from ..functions.lexicons import REFUSALS
from ..functions.parse import without_fence

Generator = Callable[[str, list[dict[str, str]]], str]
TURNS = "turns map<string,string>, reply string, status string, attempts int"


def echo(prompt: str, history: list[dict[str, str]]) -> str:
    """Deterministic stand-in: the prompt without its first word, or a refusal where the prompt asks for one."""
    return "I cannot do that." if "refuse" in prompt else " ".join(prompt.split()[1:])


def refused(reply: str) -> bool:
    return any(x in reply.lower() for x in REFUSALS)


def _ask(generator: Generator, prompt: str, history: list[dict[str, str]], tries: int, accept: Callable[[str], bool], pause: float = 0.0) -> tuple[str, int]:
    """The first reply that is accepted, or an empty one, and how many attempts it took. A failure is an attempt."""
    for attempt in range(1, tries + 1):
        try:
            reply = (generator(prompt, history) or "").strip()
        except Exception:  # noqa: BLE001  a generator's failure is a failed attempt
            reply = ""
        if reply and accept(reply):
            return reply, attempt
        if pause and attempt < tries:
            time.sleep(pause)
    return "", tries


def _parts(pdf: pd.DataFrame, texts: Sequence[str], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """A frame's rows in parts of about ``most`` characters of ``texts``: results hold them several times."""
    size = sum((pdf[c].str.len().fillna(0) for c in texts), pd.Series(1, index=pdf.index))
    for _, part in pdf.groupby((size.cumsum() // most).astype("int64"), sort=False):
        yield part


def _mapped(df: DataFrame, columns: Sequence[str], one: Callable[..., tuple], added: str) -> DataFrame:
    """``df`` with the columns that ``one`` makes of a row's ``columns``; input columns of these names are replaced."""
    new = [x.split()[0] for x in added.split(", ")]
    kept = df.select(*[f"`{c}`" for c in df.columns if c not in new], *[F.col(f"`{c}`").cast("string").alias(f"__in{k}") for k, c in enumerate(columns)])
    names = [c for c in df.columns if c not in new]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for frame in frames for part in _parts(frame, [f"__in{k}" for k in range(len(columns))])):
            values = [pdf[f"__in{k}"] for k in range(len(columns))]
            found = [one(*(v if isinstance(v, str) else None for v in row)) for row in zip(*values, strict=True)]
            yield pdf[names].assign(**{c: [x[k] for x in found] for k, c in enumerate(new)})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names]
    return kept.mapInPandas(work, ", ".join([*fields, added]))


def _fill(template: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        template = template.replace("{" + k + "}", v or "")
    return template


def run_turns(
    df: DataFrame,
    generator: Generator,
    templates: Sequence[tuple[str, str]],
    input_column: str = "text",
    max_retries: int = 1,
    sleep_seconds: float = 0.0,
    accept: Callable[[str], bool] | None = None,
    fallback: Callable[[str], str] | None = None,
    columns: Sequence[str] = (),
    opening: Sequence[dict[str, str]] = (),
    derive: Callable[[str, dict[str, str]], dict[str, str]] | None = None,
) -> DataFrame:
    """``df`` with turns (map of each key's reply), reply (the last), status and attempts.

    Templates are (key, text); ``{input}``, ``{turn_k}`` and earlier keys are filled in, missing ones empty. A turn is
    tried again while it raises, is empty or is not accepted. An empty turn ends the row: ``empty``. A refusal ends it
    as ``refused``, or goes on with the fallback's text: ``fallback``. Null input is ``skipped``. Templates may use the
    row's ``columns`` by name, the history begins with ``opening`` (priming, examples), and what ``derive`` makes of a
    turn's key and all values joins the turns. State is a row's own, so rows are independent and a lost task is simply
    run again. Input columns with the names of results are replaced.
    """
    given = {"input", *columns}

    def one(text: str | None, *more: str | None) -> tuple[dict[str, str], str, str, int]:
        if text is None or not text.strip():
            return {}, "", "skipped", 0
        values, history, reply, tries, status = {"input": text, **dict(zip(columns, (x or "" for x in more), strict=True))}, [*map(dict, opening)], "", 0, "ok"
        for k, (key, template) in enumerate(templates, 1):
            prompt = _fill(template, values)
            reply, n = _ask(generator, prompt, history, max_retries + 1, accept or bool, sleep_seconds)
            tries += n
            if refused(reply):
                if fallback is None:
                    return values_of(values), reply, "refused", tries
                reply, status = fallback(text), "fallback"
            if not reply:
                return values_of(values), "", "empty", tries
            values |= {key: reply, f"turn_{k}": reply}
            if derive:
                values |= derive(key, values)
            history += [{"role": "user", "content": prompt}, {"role": "assistant", "content": reply}]
        return values_of(values), reply, status, tries

    def values_of(values: dict[str, str]) -> dict[str, str]:
        return {k: v for k, v in values.items() if k not in given}

    return _mapped(df, [input_column, *columns], one, TURNS)


def domain_turns(df: DataFrame, generator: Generator, templates: Sequence[tuple[str, str]], domain: str = "domain", tokens: str = "n_tokens", input_column: str = "text", measured: str = "rewrite", **options: object) -> DataFrame:
    """Turns about a row's ``domain`` within a budget of its number of ``tokens``, fifteen percent either way.

    Templates may also use {domain}, {target_token_count}, {min_token_count} and {max_token_count}; after the turn
    ``measured`` also {candidate_token_count}, {length_diff} and {length_ratio}, which are among the turns. A null domain
    is empty, a null number counts as no tokens: the budget is one token then, the ratio 0. Columns with these names in
    ``df`` are used as they are, but for the four that are made here.
    """
    low, high = budget(F.coalesce(F.col(tokens), F.lit(0)))
    made = {"domain": F.coalesce(F.col(domain), F.lit("")), "target_token_count": F.coalesce(F.col(tokens), F.lit(0)), "min_token_count": low, "max_token_count": high}
    rows = df.withColumns({f"__{k}": v for k, v in made.items()})

    def lengths(key: str, values: dict[str, str]) -> dict[str, str]:
        if key != measured:
            return {}
        n, target = len(values[key].split()), int(values["target_token_count"])
        return {"candidate_token_count": str(n), "length_diff": str(n - target), "length_ratio": str(round(n / target, 3) if target else 0)}

    renamed = [(k, _fill(t, {x: "{__" + x + "}" for x in made})) for k, t in templates]
    found = run_turns(rows, generator, renamed, input_column, columns=[f"__{k}" for k in made], derive=lambda k, v: lengths(k, {x.removeprefix("__"): y for x, y in v.items()}), **options)
    return found.drop(*[f"__{k}" for k in made])


def pair_chain(df: DataFrame, generator: Generator, templates: Sequence[tuple[str, str]], first: str = "cell_a", second: str = "cell_b", max_retries: int = 1, sleep_seconds: float = 0.0) -> DataFrame:
    """A third text from two: ``df`` with turns (map), result and flag.

    Templates are (key, text) over {first}, {second} by their columns' names and earlier keys. A row whose second text is
    null, blank or a refusal is flagged ``SKIP:<second>_refusal``; one whose turn gets no reply but refusals and failures
    ``SKIP:<key>_failed``, with the turns before it. The last turn only checks: where it is refused or fails, the turn
    before it is the result. The flag is empty where all went well; a null first text counts as empty.
    """

    def one(a: str | None, b: str | None) -> tuple[dict[str, str], str, str]:
        if b is None or not b.strip() or refused(b):
            return {}, "", f"SKIP:{second}_refusal"
        values, history, turns, reply = {first: a or "", second: b}, [], {}, ""
        for k, (key, template) in enumerate(templates, 1):
            prompt = _fill(template, values | turns)
            found, _ = _ask(generator, prompt, history, max_retries + 1, lambda r: not refused(r), sleep_seconds)
            if not found and (k < len(templates) or k == 1):
                return turns, "", f"SKIP:{key}_failed"
            reply = found or reply
            turns[key] = reply
            history += [{"role": "user", "content": prompt}, {"role": "assistant", "content": reply}]
        return turns, reply, ""

    return _mapped(df, [first, second], one, "turns map<string,string>, result string, flag string")


def validated(df: DataFrame, generator: Generator, template: str, checks: dict[str, Callable[[str, str], bool]], input_column: str = "text", max_retries: int = 2, sleep_seconds: float = 0.0) -> DataFrame:
    """Replies made again while a check fails: ``df`` with reply, failed (names of the checks) and attempts.

    A check takes the input and the reply. After the last attempt its reply stays, with the checks that it fails. Without
    any reply it is null, and every check counts as failed; null input is not tried.
    """

    def one(text: str | None) -> tuple[str | None, list[str], int]:
        if text is None:
            return None, [*checks], 0
        reply, failed = None, [*checks]
        for attempt in range(1, max_retries + 2):
            got, _ = _ask(generator, _fill(template, {"input": text}), [], 1, bool)
            reply, failed = (got, [k for k, f in checks.items() if not f(text, got)]) if got else (None, [*checks])
            if got and not failed:
                break
            if sleep_seconds and attempt <= max_retries:
                time.sleep(sleep_seconds)
        return reply, failed, attempt

    return _mapped(df, [input_column], one, "reply string, failed array<string>, attempts int")


def turns_wide(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns as columns, only for export; the keys are given, so nothing is collected to find them."""
    return df.select(*[c for c in df.columns if c != "turns"], *[F.try_element_at("turns", F.lit(k)).alias(k) for k in keys])


def parsed_reply(reply, schema: str, least: int = 10):  # noqa: ANN001, ANN201
    """A JSON reply as a struct, without its fence; null if it is shorter than ``least`` or does not parse."""
    body = without_fence(reply)
    return F.when(F.length(body) >= least, F.from_json(body, schema))
