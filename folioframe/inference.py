"""Model inference as a pluggable step.

A model is a factory: it runs once in each Python worker process, whose later tasks
find the model there, and returns a function from a list of rows (dicts) to a list of
as many rows. Rows that fail come back with an error text and null outputs, so one bad
page does not stop a document; a model that returns fewer or more rows fails its batch.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

Model = Callable[[list[dict]], list[dict]]
_LOADED: dict[str, Model] = {}
_KEPT = 4


def _loaded(key: str, factory: Callable[[], Model]) -> Model:
    """The process's model of an infer() call; the last few calls' models stay."""
    if key not in _LOADED:
        while len(_LOADED) >= _KEPT:
            del _LOADED[next(iter(_LOADED))]
        _LOADED[key] = factory()
    return _LOADED[key]


class Permanent(Exception):
    """A failure that a further attempt can't mend."""


def infer(
    df: DataFrame, factory: Callable[[], Model], outputs: str, batch: int = 20, workers: int = 1, attempts: int = 3, pause: float = 0.0, drop: tuple[str, ...] = ()
) -> DataFrame:
    """df, without the columns in `drop`, with the model's outputs (DDL) and an `error` column; `workers` batches at once in
    each task, each tried `attempts` times, with a pause that doubles. A Permanent failure is not tried again."""
    names = StructType.fromDDL(outputs).fieldNames()
    passed = [(n, t) for n, t in df.dtypes if n not in drop]
    schema = ", ".join(f"`{n}` {t}" for n, t in passed) + f", {outputs}, error string"
    key = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(key, factory)

        def call(rows: list[dict]) -> list[dict]:
            error = ""
            for n in range(attempts):
                try:
                    out = model(rows)
                    return [{**r, **{k: o.get(k) for k in names}, "error": None} for r, o in zip(rows, out, strict=True)]
                except Exception as e:  # noqa: BLE001  any failure of a model is reported with its rows
                    error = f"{type(e).__name__}: {e}"
                    if isinstance(e, Permanent):
                        break
                    if n + 1 < attempts:
                        time.sleep(pause * 2**n)
            return [{**r, **dict.fromkeys(names), "error": error} for r in rows]

        with ThreadPoolExecutor(workers) as pool:
            for pdf in frames:
                rows: list[dict[str, Any]] = pdf.to_dict("records")
                chunks = [rows[i : i + batch] for i in range(0, len(rows), batch)]
                done = [r for part in pool.map(call, chunks) for r in part]
                yield pd.DataFrame(done, columns=[*(n for n, _ in passed), *names, "error"])

    return df.mapInPandas(run, schema)


def infer_by_width(df: DataFrame, factory: Callable[[], Model], outputs: str, width: Column, batch: int = 20, **options) -> DataFrame:
    """infer() with crops of like width in each batch, whatever pages they come from, for models that pad a batch to its widest.

    A range shuffle by width (how wide a crop is once all are equally high) brings likes together; each task's rows are sorted,
    and batches are cut from them in that order. So batches cover ranges of widths that hardly overlap, and all their padding
    together is at most batch * (the widest - the narrowest), however many crops there are, and a batch at each seam of the
    tasks' frames. Rows keep their keys, by which callers put them in order again. Null widths come first, among themselves."""
    name = "_width"
    while name in df.columns:
        name += "_"
    likes = df.withColumn(name, width).repartitionByRange(name).sortWithinPartitions(name)
    return infer(likes, factory, outputs, batch=batch, drop=(name, *options.pop("drop", ())), **options)


def stub_recognizer() -> Model:
    """Deterministic: reads the text that the row carries."""
    return lambda rows: [{"text": r.get("text"), "score": 1.0} for r in rows]


def prompt(first: int, size: int) -> str:
    """Instruction for a model that reads numbered crops."""
    return (
        f"The image shows {size} numbered lines of text, {first} to {first + size - 1}. Read each line exactly as written. "
        f'Answer with one JSON object from number to text, such as {{"{first}": "..."}}, and nothing else.'
    )


# Answers of a server that a further attempt may mend.
PASSING = (502, 503, 504)


def chat_request(
    row: dict, model: str, instruction: str, tokens: int = 4096, schema: dict | None = None, json_mode: bool = False, thinking: bool | None = None
) -> dict:
    """The body of a chat-completion request for a row's `text` and `image` (PNG or JPEG bytes); a JSON schema is put below the instruction."""
    import base64
    import json

    content = [{"type": "text", "text": row.get("text") or ""}]
    if row.get("image"):
        kind = "png" if row["image"][:4] == b"\x89PNG" else "jpeg"
        content.append({"type": "image_url", "image_url": {"url": f"data:image/{kind};base64," + base64.b64encode(row["image"]).decode()}})
    system = instruction if schema is None else f"{instruction}\n\nThe answer is one JSON object of this schema:\n{json.dumps(schema, ensure_ascii=False, indent=2)}"
    body = {"model": model, "temperature": 0, "max_tokens": tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": content}]}
    if json_mode:
        body["response_format"] = {"type": "json_object"}
    if thinking is not None:
        body["chat_template_kwargs"] = {"enable_thinking": thinking}
    return body


def chat_model(url: str, model: str, instruction: str, timeout: float = 120, **options) -> Callable[[], Model]:
    """A factory for rows with `text` (and `image`) that asks a chat-completion server, one request a row; gives `raw`.

    Options are those of chat_request(). Refusals other than PASSING are Permanent; infer() tries the rest again."""

    def factory() -> Model:
        import json
        import urllib.error
        import urllib.request

        def ask(row: dict) -> dict:
            body = json.dumps(chat_request(row, model, instruction, **options)).encode()
            call = urllib.request.Request(f"{url}/v1/chat/completions", body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(call, timeout=timeout) as reply:
                    return {"raw": json.load(reply)["choices"][0]["message"]["content"]}
            except urllib.error.HTTPError as e:
                if e.code in PASSING:
                    raise
                raise Permanent(f"HTTP {e.code}") from e

        return lambda rows: [ask(r) for r in rows]

    return factory


def greedy(step: Callable[[list[list[int]]], list[int]], size: int, go: int = 1, eos: int = 2, most: int = 129) -> list[list[int]]:
    """Sequences of a batch, begun with `go` and continued by a model's next tokens until each holds `eos`, or after `most` steps."""
    rows = [[go] for _ in range(size)]
    for _ in range(most):
        if all(eos in r for r in rows):
            break
        rows = [[*r, t] for r, t in zip(rows, step(rows), strict=True)]
    return rows


def served_models(url: str, timeout: float = 10) -> list[str]:
    """Names of the models a server offers; a driver-side check."""
    import json
    import urllib.request

    with urllib.request.urlopen(f"{url}/v1/models", timeout=timeout) as reply:
        return [m["id"] for m in json.load(reply)["data"]]
