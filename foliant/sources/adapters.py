"""Outside services inside a job: recognition, conversion, language models.

An adapter is any picklable callable from one request to one answer. It runs in
partitions of a DataFrame; its failures are rows, not failed jobs, so a run over
many pages goes on and can be continued from the page states.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Adapter(Protocol):
    def __call__(self, request: str | bytes) -> str: ...


class Busy(Exception):
    """The service has no room now; two tries are made in all."""


class Refused(Exception):
    """Credentials are wrong; not tried again."""


class NeedsOcr(Exception):
    """A conversion found no text layer."""


def with_retries(adapter: Adapter, request, tries: int = 3, wait: float = 1.0, busy_tries: int = 2, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer, after waits of 1, 2, 4 ... seconds between tries."""
    busy = 0
    for n in range(tries):
        try:
            return adapter(request)
        except (Refused, NeedsOcr):
            raise
        except Exception as e:
            busy += isinstance(e, Busy)
            if n + 1 == tries or busy >= busy_tries:
                raise
            sleep(wait * 2**n)
    raise ValueError("tries must be positive")


def call(rows: DataFrame, adapter: Adapter, request_col: str, key: list[str], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """key columns, answer, status (done, needs_ocr or error) and error text of each row."""

    def run(parts):
        for pdf in parts:
            out = pdf[key].copy()
            got = []
            for request in pdf[request_col]:
                try:
                    got.append((with_retries(adapter, request, tries, wait), "done", None))
                except NeedsOcr as e:
                    got.append((None, "needs_ocr", str(e)))
                except Exception as e:
                    got.append((None, "error", f"{type(e).__name__}: {e}"))
            out[["answer", "status", "error"]] = pd.DataFrame(got, index=out.index, columns=["answer", "status", "error"])
            yield out

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    return rows.select(*key, request_col).mapInPandas(run, f"{types}, answer string, status string, error string")


def blank_rows(lines: DataFrame, targets: list[str]) -> DataFrame:
    """Lines of which any target layer is blank: all that an autofill asks for."""
    some = F.lit(False)
    for t in targets:
        some = some | (F.coalesce(F.trim(t), F.lit("")) == "")
    return lines.filter(some)
