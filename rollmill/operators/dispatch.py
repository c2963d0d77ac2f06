"""Ways to hand a batch to a function on the cluster, by name; new ones can be registered."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MODES: dict[str, Callable[[DataFrame, Callable, int], DataFrame]] = {}


def register_mode(name: str, run: Callable[[DataFrame, Callable, int], DataFrame], replace: bool = False) -> None:
    if name in _MODES and not replace:
        raise ValueError(f"{name} is registered")
    _MODES[name] = run


def modes() -> list[str]:
    return sorted(_MODES)


def dispatched(df: DataFrame, function: Callable, mode: str, ways: int = 8) -> DataFrame:
    if mode not in _MODES:
        raise NotImplementedError(mode)
    return _MODES[mode](df, function, ways)


def method(mode: str, ways: int = 8):
    """A function of DataFrames (or, by its mode, of pandas frames) that is dispatched when called."""

    def wrap(function: Callable):
        @wraps(function)
        def call(df: DataFrame, *arguments) -> DataFrame:
            return dispatched(df, lambda x: function(x, *arguments), mode, ways)

        return call

    return wrap


#: The whole batch as one lazy plan; to every worker (a broadcast side); in equal chunks; by a function of pandas frames.
register_mode("all_to_all", lambda df, function, ways: function(df))
register_mode("one_to_all", lambda df, function, ways: function(F.broadcast(df)))
register_mode("dp_compute", lambda df, function, ways: function(df.repartition(ways)))
register_mode("dp_compute_with_func", lambda df, function, ways: df.repartition(ways).mapInPandas(lambda frames: map(function, frames), df.schema))


def limited(seconds: float):
    """A call that takes longer raises TimeoutError. In a main thread by a signal; elsewhere the call goes on in a thread of
    its own, which is left behind."""

    def wrap(function: Callable):
        @wraps(function)
        def call(*arguments, **named):
            if threading.current_thread() is threading.main_thread():
                def stop(*_):
                    raise TimeoutError(f"took over {seconds} s")

                before = signal.signal(signal.SIGALRM, stop)
                signal.setitimer(signal.ITIMER_REAL, seconds)
                try:
                    return function(*arguments, **named)
                finally:
                    signal.setitimer(signal.ITIMER_REAL, 0)
                    signal.signal(signal.SIGALRM, before)
            result: list = []
            errors: list[BaseException] = []

            def run():
                try:
                    result.append(function(*arguments, **named))
                except BaseException as error:  # handed to the caller
                    errors.append(error)

            thread = threading.Thread(target=run, daemon=True)
            thread.start()
            thread.join(seconds)
            if thread.is_alive():
                raise TimeoutError(f"took over {seconds} s")
            if errors:
                raise errors[0]
            return result[0]

        return call

    return wrap
