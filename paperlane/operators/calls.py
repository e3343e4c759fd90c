"""Calls of services within a task: several at a time, results in the order of the rows, a failure as a row's result."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TypeVar

R = TypeVar("R")
#: For each call that may run, so many rows are taken ahead of the first unfinished one, then reading waits.
AHEAD = 4


class Refused(Exception):
    """The service refuses the request (a 4xx answer): another attempt can't help."""


class Unavailable(Exception):
    """The service fails (a 5xx answer): another attempt follows at once."""


def called(call: Callable[[], tuple], attempts: int = 3, wait: float = 2.0, pause: Callable[[float], None] = time.sleep) -> tuple[tuple | None, str | None]:
    """(result, None), or (None, error). I/O errors wait before the next attempt, refusals end the attempts; both end in one message. Other errors are their own text."""
    for k in range(attempts):
        try:
            return call(), None
        except (Refused, PermissionError):
            break
        except Unavailable:
            pass
        except OSError:
            if k + 1 < attempts:
                pause(wait)
        except Exception as e:  # any other failure is this row's result, not the job's
            return None, str(e)
    return None, f"LLM API call failed after {attempts} attempts"


def in_order(jobs: Iterable[tuple[str, Callable[[], R]]], limits: dict[str, int]) -> Iterator[R]:
    """Results of the jobs (kind, call), in their order; of a kind no more than its limit run at a time.

    Rows are taken ahead of the first unfinished one, but only ``AHEAD`` times as many as may run: a slow call
    holds the others back once these are done, and memory stays bounded. What a job raises is raised here.
    """
    pools = {kind: ThreadPoolExecutor(n, thread_name_prefix=kind) for kind, n in limits.items()}
    waiting: deque[Future[R]] = deque()
    most = AHEAD * sum(limits.values())
    try:
        for kind, call in jobs:
            waiting.append(pools[kind].submit(call))
            if len(waiting) >= most:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
    finally:
        for pool in pools.values():
            pool.shutdown(wait=False, cancel_futures=True)
