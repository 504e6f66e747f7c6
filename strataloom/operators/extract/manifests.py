"""Manifests, dotenv files, container files, JSON Schema and OpenAPI descriptions."""

from __future__ import annotations

import json
import posixpath
import re

import yaml
from pyspark.sql import DataFrame

from .rows import flat_map

SCHEMA = "kind string, name string, value string, edge string, target string, line bigint"

# Dependency groups, and words in names of secret variables.
NPM_GROUPS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
SECRET_WORDS = ("SECRET", "TOKEN", "PASSWORD", "PASSWD", "PRIVATE_KEY", "API_KEY", "CREDENTIAL")
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


class RepeatedKey(ValueError):
    pass


def strict_json(text: str):
    """JSON without repeated keys; a ValueError otherwise."""

    def once(pairs):
        out = {}
        for k, v in pairs:
            if k in out:
                raise RepeatedKey(k)
            out[k] = v
        return out

    return json.loads(text, object_pairs_hook=once)


def package_json(doc_id, text: str):
    try:
        held = strict_json(text)
    except ValueError:
        return
    if not isinstance(held, dict):
        return
    name = held.get("name") if isinstance(held.get("name"), str) else ""
    yield doc_id, "project", name, str(held.get("version") or ""), None, None, 1
    for group in NPM_GROUPS:
        for dep, version in sorted((held.get(group) or {}).items()) if isinstance(held.get(group), dict) else ():
            yield doc_id, "external_dependency", dep, str(version), "depends_on", dep, None
    for script, line in sorted((held.get("scripts") or {}).items()) if isinstance(held.get("scripts"), dict) else ():
        yield doc_id, "build_target", script, str(line), None, None, None
    bins = held.get("bin")
    for command, target in sorted(bins.items()) if isinstance(bins, dict) else [(name, bins)] if isinstance(bins, str) else ():
        yield doc_id, "cli_command", command, str(target), None, None, None


_GO_REQUIRE = re.compile(r"^\s*(?:require\s+)?([\w.~/-]+\.[\w.~/-]+)\s+(v[\w.+-]+)")
_GO_REPLACE = re.compile(r"^\s*(?:replace\s+)?([\w.~/-]+)(?:\s+v[\w.+-]+)?\s+=>\s+(\S+)")


def go_mod(doc_id, text: str):
    block = ""
    for n, line in enumerate(text.split("\n"), 1):
        bare = line.split("//")[0].strip()
        if m := re.match(r"module\s+(\S+)", bare):
            yield doc_id, "project", m.group(1), "", None, None, n
        elif m := re.match(r"(require|replace|exclude|retract)\s*\($", bare):
            block = m.group(1)
        elif bare == ")":
            block = ""
        elif (block == "replace" or bare.startswith("replace ")) and (m := _GO_REPLACE.match(bare)):
            yield doc_id, "external_dependency", m.group(2), "", "supersedes", m.group(1), n
        elif (block == "require" or bare.startswith("require ")) and (m := _GO_REQUIRE.match(bare)):
            yield doc_id, "external_dependency", m.group(1), m.group(2), "depends_on", m.group(1), n


def requirements(doc_id, text: str):
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*((?:[<>=!~]=?[^;#\s,]+\s*,?\s*)*)", line.split("#")[0])
        if m:
            yield doc_id, "external_dependency", m.group(1), m.group(2).strip(), "depends_on", m.group(1), n


def dockerfile(doc_id, text: str):
    """Stages, base images, ports and variables; what follows FROM belongs to its stage."""
    stage = ""
    for n, line in enumerate(re.sub(r"\\\r?\n", "  ", text).split("\n"), 1):
        m = re.match(r"\s*(FROM|EXPOSE|ENV|ARG)\s+(.+)", line, re.I)
        if not m:
            continue
        word, rest = m.group(1).upper(), m.group(2).strip()
        if word == "FROM":
            image, _, alias = re.sub(r"--\S+\s+", "", rest).partition(" ")
            stage = re.sub(r"(?i)^as\s+", "", alias.strip()) or image
            yield doc_id, "build_target", stage, "", "depends_on", image, n
            yield doc_id, "container_image", image, "", None, None, n
        elif word == "EXPOSE":
            for port in rest.split():
                yield doc_id, "config_key", f"port {port}", "", "exposes", stage, n
        else:
            name, _, value = rest.partition("=") if "=" in rest.split()[0] else rest.partition(" ")
            yield doc_id, "environment_variable", name, "<redacted>" if secret_name(name) else value.strip(), "configures", stage, n


def secret_name(name: str) -> bool:
    return any(w in name.upper() for w in SECRET_WORDS)


def dotenv(doc_id, text: str):
    """Variables by name, the first of each, with or without a value; values of secret-like names are redacted."""
    seen = set()
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        name, _, value = line.removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) and name not in seen:
            seen.add(name)
            yield doc_id, "environment_variable", name, "<redacted>" if secret_name(name) and value else value, None, None, n


class _StrictLoader(yaml.BaseLoader):
    """Scalars stay texts; aliases and repeated keys are errors."""

    def compose_node(self, parent, index):
        if self.check_event(yaml.AliasEvent):
            raise yaml.composer.ComposerError(None, None, "alias", self.peek_event().start_mark)
        return super().compose_node(parent, index)

    def construct_mapping(self, node, deep=False):
        keys = [k.value for k, _ in node.value if isinstance(k, yaml.ScalarNode)]
        if len(set(keys)) < len(node.value):
            raise RepeatedKey(str(keys))
        return super().construct_mapping(node, deep)


_DESCRIBES = re.compile(r"^\s*[\"']?(?:openapi|swagger)[\"']?\s*:", re.M)


def strict_yaml(text: str):
    """One YAML document without repeated keys and aliases; a ValueError otherwise."""
    try:
        return yaml.load(text, _StrictLoader)  # noqa: S506
    except (yaml.YAMLError, RecursionError) as e:
        raise ValueError(str(e)) from e


def json_schema(doc_id, text: str):
    """Definitions, nested properties by JSON pointer, and references."""
    try:
        held = strict_json(text)
    except ValueError:
        return
    if not isinstance(held, dict) or not ("$schema" in held or "properties" in held or "$defs" in held or "definitions" in held):
        return
    esc = lambda k: str(k).replace("~", "~0").replace("/", "~1")
    todo = [("#", held, "schema", str(held.get("title") or ""))]
    while todo:
        at, node, kind, name = todo.pop()
        if not isinstance(node, dict):
            continue
        yield doc_id, kind, name or at, str(node.get("type") or ""), "contains" if at != "#" else None, at, None
        if isinstance(node.get("$ref"), str):
            yield doc_id, None, at, None, "references", node["$ref"], None
        for group, kind_ in (("$defs", "schema"), ("definitions", "schema"), ("properties", "field")):
            if isinstance(node.get(group), dict):
                todo += [(f"{at}/{group}/{esc(k)}", v, kind_, str(k)) for k, v in node[group].items()]
        if isinstance(node.get("items"), dict):
            todo.append((f"{at}/items", node["items"], "field", "items"))


def openapi(doc_id, text: str, read=strict_json):
    """Services, endpoints, parameters, responses, schemas and security schemes of a description, JSON or, by *read*, YAML, with its references."""
    try:
        held = read(text)
    except ValueError:
        return
    if not isinstance(held, dict) or not ("openapi" in held or "swagger" in held):
        return
    info = held.get("info") if isinstance(held.get("info"), dict) else {}
    title = str(info.get("title") or "")
    yield doc_id, "api_service", title, str(info.get("version") or ""), None, None, None
    for path, item in (held.get("paths") or {}).items():
        if not isinstance(item, dict):
            continue
        for method in METHODS:
            op = item.get(method)
            if not isinstance(op, dict):
                continue
            name = f"{method.upper()} {path}"
            yield doc_id, "api_endpoint", name, str(op.get("operationId") or ""), "exposes", title, None
            for p in [*(item.get("parameters") or []), *(op.get("parameters") or [])]:
                if isinstance(p, dict) and "name" in p:
                    yield doc_id, "parameter", str(p["name"]), str(p.get("in") or ""), "contains", name, None
            for code in sorted(op.get("responses") or {}):
                yield doc_id, "return_value", str(code), "", "contains", name, None
    components = held.get("components") if isinstance(held.get("components"), dict) else {}
    for name in sorted(components.get("schemas") or held.get("definitions") or {}):
        yield doc_id, "schema", name, "", "contains", title, None
    for name in sorted(components.get("securitySchemes") or held.get("securityDefinitions") or {}):
        yield doc_id, "security_scheme", name, "", "contains", title, None
    todo = [held]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                yield doc_id, None, None, None, "references", x["$ref"], None
            todo += list(x.values())
        elif isinstance(x, list):
            todo += x


def any_manifest(doc_id, path: str | None, text: str | None):
    """The rows of whichever kind of manifest a path is."""
    name, text = posixpath.basename(path or "").lower(), text or ""
    if name == "package.json":
        yield from package_json(doc_id, text)
    elif name == "go.mod":
        yield from go_mod(doc_id, text)
    elif re.fullmatch(r"requirements[\w.-]*\.txt", name):
        yield from requirements(doc_id, text)
    elif name == "dockerfile" or name.startswith("dockerfile.") or name.endswith(".dockerfile"):
        yield from dockerfile(doc_id, text)
    elif name == ".env" or name.endswith(".env") or name.startswith(".env."):
        yield from dotenv(doc_id, text)
    elif name.endswith(".json"):
        yield from json_schema(doc_id, text)
        yield from openapi(doc_id, text)
    elif name.endswith((".yaml", ".yml")) and _DESCRIBES.search(text):
        yield from openapi(doc_id, text, strict_yaml)


def manifest_table(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, path, text)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    return flat_map(docs.select("doc_id", "path", "text"), any_manifest, f"doc_id {key}, {SCHEMA}")
