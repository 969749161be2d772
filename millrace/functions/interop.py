"""Frames of other libraries, Python code in a process of its own, and closures side by side."""

from __future__ import annotations

import pickle
import subprocess
import sys
import tempfile
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Rows that leave the cluster as a local frame, at most.
MAX_ROWS = 5_000_000


def to_pandas(df: DataFrame):
    if df.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows")
    return df.toPandas()


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    return spark.createDataFrame(frame)


def to_series(df: DataFrame, column: str):
    return to_pandas(df.select(column))[column]


def run_code(code: str, timeout: float | None = None, **variables):
    """Run Python code in another process; what it binds to ``result`` comes back."""
    with tempfile.NamedTemporaryFile(suffix=".pkl") as out:
        body = f"import pickle as _p, sys as _s\nglobals().update(_p.loads(_s.stdin.buffer.read()))\n{code}\nwith open({out.name!r}, 'wb') as _f:\n    _p.dump(globals().get('result'), _f)\n"
        done = subprocess.run([sys.executable, "-c", body], input=pickle.dumps(variables), capture_output=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(done.stderr.decode(errors="replace")[-2000:])
        with open(out.name, "rb") as f:
            return pickle.load(f)  # noqa: S301  our own process wrote it


def run_file(path: str, timeout: float | None = None, **variables):
    with open(path) as f:
        return run_code(f.read(), timeout, **variables)


@dataclass
class Group:
    """Functions that run side by side; Spark jobs of several threads share the cluster."""

    functions: Sequence[Callable]
    futures: list[Future] = field(default_factory=list)

    def run(self) -> "Group":
        pool = ThreadPoolExecutor(max(1, len(self.functions)))
        self.futures = [pool.submit(f) for f in self.functions]
        pool.shutdown(wait=False)
        return self

    def results(self) -> list:
        return [f.result() for f in self.futures]

    def wait(self) -> None:
        self.results()


@dataclass
class Actor:
    """Runs functions one after another, whichever thread asks: what they share needs no lock of its own."""

    pool: ThreadPoolExecutor = field(default_factory=lambda: ThreadPoolExecutor(1))

    def do(self, f: Callable, *args):
        return self.pool.submit(f, *args).result()


def packages() -> dict[str, str]:
    """Names and versions of the installed Python packages."""
    from importlib.metadata import distributions

    return dict(sorted((d.metadata["Name"], d.version) for d in distributions() if d.metadata["Name"]))


def freeze() -> str:
    return "\n".join(f"{k}=={v}" for k, v in packages().items())


def pip(action: str, *names: str, timeout: float | None = None) -> str:
    """Install or uninstall packages for this Python; executors have Pythons of their own (``spark.addArtifacts``)."""
    if action not in ("install", "uninstall"):
        raise ValueError(f"can't {action}")
    done = subprocess.run([sys.executable, "-m", "pip", action, *(["-y"] if action == "uninstall" else []), *names], capture_output=True, timeout=timeout, check=False, text=True)
    if done.returncode:
        raise RuntimeError(done.stderr[-2000:])
    return done.stdout
