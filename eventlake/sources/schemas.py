"""A schema registry: subjects, versions and ids, and compatibility of Avro, JSON and Protobuf schemas."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from eventlake.errors import IncompatibleSchema, InvalidQuery
from eventlake.session import complete, store_text

MODES = ("none", "backward", "backward_transitive", "forward", "forward_transitive", "full", "full_transitive")

#: What a reader's type accepts from a writer's, beside the same type.
_PROMOTIONS = {"long": {"int"}, "float": {"int", "long"}, "double": {"int", "long", "float"}, "string": {"bytes"}, "bytes": {"string"}}


def avro_reads(reader, writer) -> list[str]:
    """Why a reader's Avro schema can't read what a writer's wrote; empty if it can."""
    r, w = _avro(reader), _avro(writer)
    if isinstance(w, list):
        return [p for branch in w for p in avro_reads(r, branch)]
    if isinstance(r, list):
        return [] if any(not avro_reads(branch, w) for branch in r) else [f"no branch reads {_name(w)}"]
    rt, wt = _name(r), _name(w)
    if rt == "record" and wt == "record":
        old = {f["name"]: f for f in w["fields"]}
        out = []
        for f in r["fields"]:
            names = [f["name"], *f.get("aliases", [])]
            known = next((old[n] for n in names if n in old), None)
            if known is not None:
                out += [f"{f['name']}: {p}" for p in avro_reads(f["type"], known["type"])]
            elif "default" not in f:
                out.append(f"{f['name']}: new field without a default")
        return out
    if rt == wt == "array":
        return avro_reads(r["items"], w["items"])
    if rt == wt == "map":
        return avro_reads(r["values"], w["values"])
    if rt == wt == "enum":
        missing = sorted(set(w["symbols"]) - set(r["symbols"]))
        return [] if not missing or "default" in r else [f"no symbol {m}" for m in missing]
    if rt == wt == "fixed":
        return [] if r["size"] == w["size"] else ["sizes differ"]
    return [] if rt == wt or wt in _PROMOTIONS.get(rt, ()) else [f"{rt} doesn't read {wt}"]


def _avro(schema):
    if isinstance(schema, dict) and isinstance(schema.get("type"), (dict, list)):
        return schema["type"]
    return schema


def _name(schema) -> str:
    return schema["type"] if isinstance(schema, dict) else schema


def json_reads(reader: dict, writer: dict, path: str = "") -> list[str]:
    """Why documents of a writer's JSON schema may fail a reader's; empty if none does."""
    out = []
    new = set(reader.get("required", [])) - set(writer.get("required", []))
    out += [f"{path}{n}: newly required" for n in sorted(new)]
    r, w = _kinds(reader), _kinds(writer)
    if r and (not w or not all(k in r or (k == "integer" and "number" in r) for k in w)):
        out.append(f"{path or 'document'}: {sorted(r)} doesn't take {sorted(w) or 'any'}")
    if reader.get("additionalProperties") is False:
        gone = set(writer.get("properties", {})) - set(reader.get("properties", {}))
        out += [f"{path}{n}: no longer allowed" for n in sorted(gone)]
    if "enum" in reader:
        missing = [e for e in writer.get("enum", [None]) if e not in reader["enum"]]
        out += [f"{path or 'document'}: {m!r} is no longer a value" for m in missing]
    for name in sorted(set(reader.get("properties", {})) & set(writer.get("properties", {}))):
        out += json_reads(reader["properties"][name], writer["properties"][name], f"{path}{name}.")
    if isinstance(reader.get("items"), dict) and isinstance(writer.get("items"), dict):
        out += json_reads(reader["items"], writer["items"], f"{path}[].")
    return out


def _kinds(schema: dict) -> set[str]:
    kind = schema.get("type", [])
    return {kind} if isinstance(kind, str) else set(kind)


_FIELD = re.compile(r"(?:(optional|required|repeated)\s+)?([\w.]+(?:\s*<[^>]*>)?)\s+(\w+)\s*=\s*(\d+)")


def proto_reads(reader: str, writer: str) -> list[str]:
    """Why a reader's Protobuf message can't read a writer's: a number whose type changed, or a field that became required."""
    new, old = ({int(n): (label, kind, name) for label, kind, name, n in _FIELD.findall(s)} for s in (reader, writer))
    wire = {"int32": "v", "int64": "v", "uint32": "v", "uint64": "v", "bool": "v", "sint32": "z", "sint64": "z", "string": "s", "bytes": "s"}
    out = [f"{new[n][2]}: type of number {n} changed" for n in sorted(set(new) & set(old)) if wire.get(new[n][1], new[n][1]) != wire.get(old[n][1], old[n][1])]
    return out + [f"{new[n][2]}: newly required" for n in sorted(set(new) - set(old)) if new[n][0] == "required"]


def problems(kind: str, reader: str, writer: str) -> list[str]:
    if kind == "avro":
        return avro_reads(json.loads(reader), json.loads(writer))
    if kind == "json":
        return json_reads(json.loads(reader), json.loads(writer))
    if kind == "protobuf":
        return proto_reads(reader, writer)
    raise InvalidQuery(f"no schema type: {kind}")


def check(kind: str, new: str, earlier: list[str], mode: str) -> list[str]:
    """Problems of a new schema against earlier ones, newest last. Backward: the new one reads the old ones' data; forward: the other
    way round; transitive modes look at all versions, the others at the newest."""
    if mode not in MODES:
        raise InvalidQuery(f"no compatibility mode: {mode}")
    out = []
    for old in earlier if mode.endswith("transitive") else earlier[-1:]:
        if mode.startswith(("backward", "full")):
            out += problems(kind, new, old)
        if mode.startswith(("forward", "full")):
            out += problems(kind, old, new)
    return out


@dataclass
class Subject:
    kind: str
    versions: list[int] = field(default_factory=list)


@dataclass
class Registry:
    """Schemas by id; subjects list their ids. Equal schemas share an id."""

    mode: str = "backward"
    schemas: list[tuple[str, str]] = field(default_factory=list)
    subjects: dict[str, Subject] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)

    def register(self, subject: str, schema: str, kind: str = "avro") -> int:
        known = self.subjects.setdefault(subject, Subject(kind))
        text = schema if kind == "protobuf" else json.dumps(json.loads(schema), sort_keys=True)
        for i in known.versions:
            if self.schemas[i - 1] == (kind, text):
                return i
        found = check(kind, text, [self.schemas[i - 1][1] for i in known.versions], self.modes.get(subject, self.mode))
        if found:
            raise IncompatibleSchema("; ".join(found))
        if (kind, text) not in self.schemas:
            self.schemas.append((kind, text))
        known.versions.append(self.schemas.index((kind, text)) + 1)
        return known.versions[-1]

    def get(self, schema_id: int) -> str:
        return self.schemas[schema_id - 1][1]

    def save(self, spark: SparkSession, root: str) -> int:
        """Store the registry as a new version in a folder, written whole; returns its number. One writer at a time."""
        number = max(map(int, complete(spark, root)), default=0) + 1
        text = json.dumps({"mode": self.mode, "schemas": self.schemas, "subjects": {n: [s.kind, s.versions] for n, s in self.subjects.items()}, "modes": self.modes})
        store_text(spark, f"{root.rstrip('/')}/{number}", text)
        return number

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Registry:
        """The last version that was stored whole; an empty registry if there is none."""
        numbers = [int(n) for n in complete(spark, root)]
        if not numbers:
            return cls()
        held = json.loads(spark.read.text(f"{root.rstrip('/')}/{max(numbers)}").first()["value"])
        subjects = {n: Subject(kind, versions) for n, (kind, versions) in held["subjects"].items()}
        return cls(held["mode"], [tuple(s) for s in held["schemas"]], subjects, held["modes"])

    def version(self, subject: str, number: int | None = None) -> str:
        """A subject's schema by version from 1, the latest by default."""
        return self.get(self.subjects[subject].versions[-1 if number is None else number - 1])
