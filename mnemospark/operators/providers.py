"""Language-model providers behind an interface, with answers cached by text; a deterministic one serves offline."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """Answers a prompt with JSON of the given keys."""

    name: str

    def available(self) -> bool: ...

    def invoke(self, system: str, prompt: str, keys: list[str]) -> dict[str, str]: ...


class Offline:
    """Answers from the prompt's hash: the same prompt, the same answer."""

    name = "offline"

    def available(self) -> bool:
        return True

    def invoke(self, system: str, prompt: str, keys: list[str]) -> dict[str, str]:
        h = hashlib.sha256(f"{system}\x00{prompt}".encode()).hexdigest()
        return {k: h[8 * n : 8 * n + 8] for n, k in enumerate(keys)}


def resolve(name: str | None, known: dict[str, Callable[[], Provider]]) -> Provider:
    """The named provider if it is available, else the first that is, else the offline one."""
    for key in [name, *known] if name in known else known:
        found = known[key]()
        if found.available():
            return found
    return Offline()


def answered(rows: DataFrame, provider: Provider, system: str, keys: list[str], cache: DataFrame | None = None) -> DataFrame:
    """(id, digest, answer, error) of rows (id, prompt); what the cache (digest, answer) holds is not asked again.

    A call that gives no JSON of the keys is tried once more; then the row has an error and the others go on.
    """
    wanted = rows.select("id", "prompt", F.sha2(F.concat_ws("\x00", F.lit(system), "prompt"), 256).alias("digest"))
    none = F.lit(None).cast("string")

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for digest, prompt in zip(frame["digest"], frame["prompt"]):
                answer, error = None, None
                for _ in range(2):
                    try:
                        found = provider.invoke(system, prompt, keys)
                        if set(found) != set(keys):
                            raise ValueError("answer has other keys")
                        answer, error = json.dumps(found, sort_keys=True), None
                        break
                    except Exception as e:  # noqa: BLE001  one row's failure is its own
                        error = f"{type(e).__name__}: {e}"
                out.append((digest, answer, error))
            yield pd.DataFrame(out, columns=["digest", "answer", "error"])

    new = wanted.select("digest", "prompt").dropDuplicates(["digest"])
    if cache is not None:
        new = new.join(cache.select("digest"), "digest", "left_anti")
    known = new.mapInPandas(task, "digest string, answer string, error string")
    if cache is not None:
        known = known.union(cache.select("digest", "answer", none))
    return wanted.join(known, "digest").select("id", "digest", "answer", "error")
