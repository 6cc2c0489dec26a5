"""Declarative pipelines: a document of steps becomes a dictionary of lazy tables.

A document has inputs (dataset_name), steps (driver, inputs with source_step and source_dataset_name,
outputs) and outputs (the same sources).  Step 0 is the document's inputs.  Drivers are functions that
take and return dictionaries of DataFrames; nothing runs until a sink asks for a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

Driver = Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]


def status(document: Mapping) -> str:
    """empty, incomplete (something missing, unfed or unnamed) or valid."""
    inputs, steps, outputs = document.get("inputs", []), document.get("steps", []), document.get("outputs", [])
    if not (inputs or steps or outputs):
        return "empty"
    wires = [w for s in steps for w in s.get("inputs", [])] + list(outputs)
    fed = all(w.get("source_dataset_name") and w.get("source_step") is not None for w in wires)
    used = {(w.get("source_step"), w.get("source_dataset_name")) for w in wires}
    made = {(k, o) for k, s in enumerate(steps, 1) for o in s.get("outputs", [])}
    return "valid" if inputs and steps and outputs and fed and made <= used else "incomplete"


def phases(document: Mapping) -> list[list[int]] | None:
    """Steps (from 1) by phase; None where a cycle leaves some without one.  Small documents, so plain Python."""
    sources = {k: {w["source_step"] for w in s.get("inputs", []) if w["source_step"]} for k, s in enumerate(document["steps"], 1)}
    done: set[int] = set()
    out = []
    while len(done) < len(sources):
        ready = [k for k, need in sources.items() if k not in done and need <= done]
        if not ready:
            return None
        out.append(ready)
        done |= set(ready)
    return out


def run(document: Mapping, inputs: Mapping[str, DataFrame], drivers: Mapping[str, Driver]) -> dict[str, DataFrame]:
    """The document's outputs by name.  Steps run in phase order; a missing driver, input or output is an error."""
    order = phases(document)
    if status(document) != "valid" or order is None:
        raise ValueError(f"the pipeline is {status(document)}" if order else "the pipeline has a cycle")
    tables = {(0, i["dataset_name"]): inputs[i["dataset_name"]] for i in document["inputs"]}
    for k in (k for phase in order for k in phase):
        step = document["steps"][k - 1]
        made = drivers[step["driver"]]({w["dataset_name"]: tables[w["source_step"], w["source_dataset_name"]] for w in step["inputs"]})
        tables |= {(k, name): made[name] for name in step["outputs"]}
    return {o["dataset_name"]: tables[o["source_step"], o["source_dataset_name"]] for o in document["outputs"]}
