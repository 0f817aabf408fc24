"""Run records of the driver: a ledger with states, provenance, query-set hashes, and small result files."""

from __future__ import annotations

import csv
import datetime
import hashlib
import json
import os
import subprocess

from pyspark.sql import DataFrame

from rankspark.sources.files import append_json_lines

#: Longest message of a failure that is kept.
MESSAGE = 4000


def now() -> str:
    """The time in UTC, ISO form."""
    return datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")


class RunLedger:
    """An append-only file of run states: started, then finished or failed once. The last line of a run is its state."""

    def __init__(self, path: str):
        self.path = path

    def runs(self) -> dict[str, dict]:
        """The state of every run; a torn last line doesn't count."""
        out: dict[str, dict] = {}
        if os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as file:
                for line in file:
                    if line.endswith("\n"):
                        row = json.loads(line)
                        out[row["run"]] = {**out.get(row["run"], {}), **row}
        return out

    def _add(self, run: str, status: str, **more) -> None:
        append_json_lines(self.path, [{"run": run, "status": status, "at": now(), **more}])

    def start(self, run: str, **settings) -> None:
        if run in self.runs():
            raise ValueError(f"run {run!r} is in the ledger")
        self._add(run, "running", settings=settings)

    def _end(self, run: str, status: str, **more) -> None:
        if (state := self.runs().get(run, {}).get("status")) != "running":
            raise ValueError(f"run {run!r} is {state or 'unknown'}, not running")
        self._add(run, status, **more)

    def finish(self, run: str, **results) -> None:
        self._end(run, "finished", results=results)

    def fail(self, run: str, error: BaseException | str) -> None:
        self._end(run, "failed", message=str(error)[:MESSAGE])


def query_set_hash(queries: list[dict]) -> str:
    """16 hexadecimal digits of the sha256 of the queries as sorted JSON; their order and that of their fields don't matter."""
    rows = sorted(json.dumps(q, sort_keys=True, ensure_ascii=False) for q in queries)
    return hashlib.sha256(json.dumps(rows, ensure_ascii=False).encode()).hexdigest()[:16]


def file_hash(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def provenance(files: list[str] | None = None, **seeds) -> dict:
    """What a result came from: time, commit of the working folder (null without one), seeds, and hashes of files."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        commit = None
    return {"at": now(), "commit": commit, "seeds": seeds, "files": {f: file_hash(f) for f in files or []}}


def stale(bundle: dict) -> list[str]:
    """The files of a provenance record that changed or are gone since."""
    return [f for f, h in bundle["files"].items() if not os.path.exists(f) or file_hash(f) != h]


def write_report(table: DataFrame, folder: str, name: str, most: int = 10_000) -> None:
    """A small result as name.json, name.csv and name.md. A result of more than `most` rows is an error: it belongs in a table."""
    rows = [r.asDict(recursive=True) for r in table.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"{name} has over {most} rows; write it as a table")
    os.makedirs(folder, exist_ok=True)
    base, columns = os.path.join(folder, name), table.columns
    with open(base + ".json", "w", encoding="utf-8") as file:
        json.dump(rows, file, ensure_ascii=False, indent=1, default=str)
    with open(base + ".csv", "w", encoding="utf-8", newline="") as file:
        writer = csv.DictWriter(file, columns)
        writer.writeheader()
        writer.writerows(rows)
    with open(base + ".md", "w", encoding="utf-8") as file:
        cell = lambda v: "" if v is None else (f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " "))
        for line in (columns, ["-"] * len(columns), *([cell(r[c]) for c in columns] for r in rows)):
            file.write("|" + "|".join(line) + "|\n")
