"""Requests to a model service from inside a task: many at a time, asked again where that helps.

A transport is a function from a request (a JSON object) to (status, response). It is opened in
the task, once for each. What fails after all tries is a row with its error, never an exception:
Spark would run the task again, and ask all its requests once more.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

Transport = Callable[[dict[str, Any]], tuple[int, Any]]
WORKERS = 8
#: Characters of a refused request's response that its error shows.
SHOWN = 600
#: Statuses under 500 that are worth another try: time-outs, conflicts and rate limits (fixed values).
PASSING = frozenset({408, 409, 425, 429})


class ServiceError(RuntimeError):
    """A request that was refused, or that failed at every try."""


@dataclass(frozen=True)
class Retry:
    """How often a request is tried, and the seconds before the second try; each wait is twice the last."""

    tries: int = 3
    wait: float = 1.0

    def waits(self) -> list[float]:
        return [self.wait * 2**k for k in range(self.tries - 1)]


def should_retry(status: int) -> bool:
    """Whether a status may be another at the next try."""
    return status >= 500 or status in PASSING


def ask(transport: Transport, body: dict[str, Any], retry: Retry | None = None, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The response to ``body``. Faults of the transport and passing statuses are tried again.

    A status that no other try would change raises at once, with the response's text: it says
    what was wrong with the request.
    """
    said = ""
    for wait in [*(retry or Retry()).waits(), None]:
        try:
            status, response = transport(body)
        except Exception as e:  # noqa: BLE001  any fault of the line is worth a try
            said = f"{type(e).__name__}: {e}"
        else:
            if status < 400:
                return response
            said = f"status {status}"
            if not should_retry(status):
                text = response if isinstance(response, str) else json.dumps(response, ensure_ascii=False)
                raise ServiceError(f"{said}: {text[:SHOWN]}")
        if wait is not None:
            sleep(wait)
    raise ServiceError(f"no answer at any try: {said}")


def http(url: str, key: str, timeout: float = 60.0) -> Transport:
    """JSON over HTTP with a bearer key."""
    if not key:
        raise ValueError("the service's key is missing")

    def send(body: dict[str, Any]) -> tuple[int, Any]:
        import urllib.error
        import urllib.request

        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
        request = urllib.request.Request(url, json.dumps(body, ensure_ascii=False).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as got:
                return got.status, json.load(got)
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")

    return send


def served(requests: DataFrame, connect: Callable[[], Transport], workers: int = WORKERS, retry: Retry | None = None) -> DataFrame:
    """(request_id, response, error) of (request_id, body), both JSON texts; one of the last two is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transport = connect()

        def one(body: str) -> tuple[str | None, str | None]:
            try:
                return json.dumps(ask(transport, json.loads(body), retry), ensure_ascii=False), None
            except Exception as e:  # noqa: BLE001  a failure is a row
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                found = list(pool.map(one, batch.column(1).to_pylist()))
                said, errors = ([x[k] for x in found] for k in (0, 1))
                yield pa.record_batch({"request_id": batch.column(0), "response": pa.array(said, pa.string()), "error": pa.array(errors, pa.string())})

    return requests.select("request_id", "body").mapInArrow(run, "request_id string, response string, error string")
