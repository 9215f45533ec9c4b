"""A catalogue of skills from Markdown files with front matter: read once on the driver, used as small dimensions.

A skill's tools become function schemas; its triggers a table for `understanding.match_skill`; its reference documents a
table of paths. Handlers are functions that the caller registers by name: no file is ever run.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a skill's file is called, and what counts as a reference document.
SKILL_FILES = ("SKILL.md", "skill.md")
REFERENCE_SUFFIXES = (".md", ".markdown", ".txt", ".json")
PARAMETER = ("enum", "default")


@dataclass(frozen=True)
class Tool:
    name: str
    description: str = ""
    parameters: dict[str, dict[str, Any]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    handler: dict[str, str] = field(default_factory=dict)

    def schema(self) -> dict[str, Any]:
        shape = {"type": "object", "properties": self.parameters, "required": list(self.required)}
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": shape}}


@dataclass(frozen=True)
class Skill:
    skill_id: str
    name: str
    description: str = ""
    version: str = "1.0.0"
    enabled: bool = True
    tags: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    tools: tuple[Tool, ...] = ()
    prompt: str = ""
    path: str = ""


class Loader(Protocol):
    """What reads one format of skills."""

    def can_load(self, path: str) -> bool: ...

    def load(self, path: str) -> list[Skill]: ...


def parameters(raw: Any) -> tuple[dict[str, dict[str, Any]], tuple[str, ...]]:
    """(properties, names of those required) from the full form, a map of fields, or the short one, a type's name."""
    found, required = {}, []
    for name, value in (raw or {}).items() if isinstance(raw, dict) else ():
        if isinstance(value, str):
            found[name] = {"type": value, "description": ""}
        elif isinstance(value, dict):
            found[name] = {"type": value.get("type", "string"), "description": value.get("description", "")} | {k: value[k] for k in PARAMETER if k in value}
            if value.get("required", False):
                required.append(name)
    return found, tuple(required)


class MarkdownLoader:
    """Markdown with YAML between two lines of three dashes."""

    def can_load(self, path: str) -> bool:
        if not path.lower().endswith((".md", ".markdown")):
            return False
        if os.path.basename(path) in SKILL_FILES:
            return True
        with open(path, encoding="utf-8") as f:
            return f.read(64).lstrip().startswith("---")

    def load(self, path: str) -> list[Skill]:
        import yaml

        with open(path, encoding="utf-8") as f:
            text = f.read()
        head, body = {}, text
        if text.startswith("---") and (end := text.find("\n---", 3)) > 0:
            head, body = yaml.safe_load(text[3:end]) or {}, text[text.find("\n", end + 1) + 1 :]
        folder = os.path.basename(os.path.dirname(path))
        trigger = head.get("trigger") or {}
        tools = []
        for t in head.get("tools") or ():
            if isinstance(t, dict):
                found, required = parameters(t.get("parameters"))
                handler = {k: str(t[k]) for k in ("external_system", "connector_method", "script") if t.get(k) is not None}
                tools.append(Tool(str(t.get("name", "unknown")), str(t.get("description", "")), found, required, handler))
        some = lambda d, k: tuple(map(str, d.get(k) or ()))
        return [Skill(
            str(head.get("name", head.get("id", folder))), str(head.get("name", folder)), str(head.get("description", "")), str(head.get("version", "1.0.0")), bool(head.get("enabled", True)),
            some(head, "tags"), some(trigger, "keywords"), some(trigger, "patterns"), tuple(tools), body.strip(), path,
        )]


@dataclass
class Catalog:
    """Skills by id, in the order in which they were found; a later one of the same id takes its place."""

    loaders: tuple[Loader, ...] = (MarkdownLoader(),)
    skills: dict[str, Skill] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    handlers: dict[str, Callable[..., Any]] = field(default_factory=dict)

    def scan(self, root: str) -> Catalog:
        """Reads all skills below root with the first loader that takes a file. A file that can't be read is noted in `failed`
        and doesn't stop the scan."""
        for folder, folders, names in os.walk(root):
            folders.sort()
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    loader = next((x for x in self.loaders if x.can_load(path)), None)
                    for skill in loader.load(path) if loader else ():
                        self.skills[skill.skill_id] = skill
                except Exception as e:
                    self.failed[path] = f"{type(e).__name__}: {e}"
        return self

    def enabled(self) -> list[Skill]:
        return [s for s in self.skills.values() if s.enabled]

    def schemas(self) -> list[dict[str, Any]]:
        return [t.schema() for s in self.enabled() for t in s.tools]

    def register(self, spark: SparkSession, name: str, handler: Callable[..., Any], returns: str) -> None:
        """A tool's handler by name, for SQL too."""
        self.handlers[name] = handler
        spark.udf.register(name, handler, returns)

    def triggers(self, spark: SparkSession) -> DataFrame:
        """(skill, keyword, pattern, ord, enabled) for `understanding.match_skill`."""
        rows = []
        for i, s in enumerate(self.skills.values()):
            rows += [(s.skill_id, k.lower(), None, i, s.enabled) for k in s.keywords] + [(s.skill_id, None, f"(?i){p}", i, s.enabled) for p in s.patterns]
        return spark.createDataFrame(rows, "skill string, keyword string, pattern string, ord int, enabled boolean")


def references(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, length) of the reference documents below root; their content is read only when it is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = F.lit(False)
    for suffix in REFERENCE_SUFFIXES:
        kept = kept | F.endswith(F.lower("path"), F.lit(suffix))
    return files.where(kept).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")
