"""Calls that may fail for a while: which answers are tried again, after how long, and when to give up."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Answers that pass: timeouts, conflicts of load, server errors.
PASSING = frozenset({408, 422, 429})


@dataclass(frozen=True)
class Policy:
    """Waits double from ``first`` seconds on, up to ``most``; ``most_network`` bounds them after a broken connection."""

    attempts: int = 6
    first: float = 2.0
    most: float = 120.0
    most_network: float = 60.0
    unreadable: float = 3.0

    def wait(self, attempt: int, network: bool = False) -> float:
        return min(self.most_network if network else self.most, self.first * 2**attempt)


#: Paged reads of an archive, and calls of a chat model.
ARCHIVE, CHAT = Policy(), Policy(attempts=5, first=1.0, most=30.0, most_network=30.0)


def get_json(fetch: Callable[[], tuple[int, str]], policy: Policy = ARCHIVE, sleep: Callable[[float], None] = time.sleep):
    """The parsed answer of ``fetch`` (status and text), or None if it can't be had.

    Passing statuses, all of 500 and above and broken connections (``OSError``) are tried again after
    growing waits, an unreadable answer after a fixed one; any other status of 400 and above is final.
    """
    for attempt in range(policy.attempts):
        try:
            status, text = fetch()
        except OSError:
            sleep(policy.wait(attempt, network=True))
            continue
        if status in PASSING or status >= 500:
            sleep(policy.wait(attempt))
            continue
        if status >= 400:
            return None
        try:
            return json.loads(text)
        except ValueError:
            sleep(policy.unreadable)
    return None


def fetch_all(requests: DataFrame, key: str, fetch: Callable[[str], tuple[int, str]], policy: Policy = ARCHIVE, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``key, answer, waited``: one call per row, tried again by ``policy``; the answer is null where it was given up."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k in f[key]:
                waits: list[float] = []

                def pause(seconds: float) -> None:
                    waits.append(seconds)  # noqa: B023
                    sleep(seconds)

                found = get_json(lambda: fetch(k), policy, pause)  # noqa: B023
                out.append((k, None if found is None else json.dumps(found, sort_keys=True), sum(waits)))
            yield pd.DataFrame(out, columns=[key, "answer", "waited"])

    return requests.select(key).mapInPandas(run, f"{key} string, answer string, waited double")
