"""Facts of Maven files: what a pom calls itself and its parent, the properties it sets, and the generator runs it configures."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET

# The plugins that generate, and the expressions that name the folder of a pom.
PLUGINS = ("openapi-generator-maven-plugin", "swagger-codegen-maven-plugin")
BASEDIRS = ("project.basedir", "basedir", "pom.basedir")
#: Substitution passes, and the characters at which a value that names itself is given up; what still holds an expression then is unresolved.
PASSES, LONGEST = 10, 1 << 16


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _child(e, name: str) -> str | None:
    return next((c.text.strip() for c in e if _name(c) == name and c.text and c.text.strip()), None)


def parent_path(folder: str, told: str | None) -> str | None:
    """Where a pom says that its parent lies: one folder up unless told; None if told to look elsewhere, or outside the repository."""
    if told == "":
        return None
    path = posixpath.normpath(posixpath.join(folder, told or "../pom.xml"))
    path = path if path.endswith(".xml") else posixpath.normpath(posixpath.join(path, "pom.xml"))
    return None if path.startswith(("..", "/")) else path


def _configured(e, profile: bool = False):
    """(configuration, in a profile) of generator plugins that can run: what pluginManagement holds are defaults only."""
    for c in e:
        name = _name(c)
        if name == "plugin" and _child(c, "artifactId") in PLUGINS:
            yield from ((conf, profile) for conf in c.iter() if _name(conf) == "configuration")
        elif name != "pluginManagement":
            yield from _configured(c, profile or name == "profiles")


def pom(text: str, path: str) -> dict | None:
    """The facts of a pom, as one dict; None for a file with a document type, which is no pom. Malformed files raise."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None
    root = ET.fromstring(text)
    own = {k: _child(root, k) for k in ("groupId", "artifactId", "version")}
    above = next((e for e in root if _name(e) == "parent"), None)
    parent = {k: None if above is None else _child(above, k) for k in own}
    told = None if above is None else next(((e.text or "").strip() for e in above if _name(e) == "relativePath"), None)
    set_ = {_name(p): p.text.strip() for e in root.iter() if _name(e) == "properties" for p in e if p.text and p.text.strip()}
    runs = []
    for conf, profile in _configured(root):
        generator, spec = _child(conf, "generatorName") or _child(conf, "language"), _child(conf, "inputSpec")
        if generator or spec:
            runs.append({"generator": generator or "", "input": spec, "skip": _child(conf, "skip"), "api_package": _child(conf, "apiPackage"), "provisional": profile})
    return {
        "group_id": own["groupId"] or parent["groupId"], "artifact_id": own["artifactId"], "version": own["version"] or parent["version"],
        "parent_group": parent["groupId"], "parent_artifact": parent["artifactId"], "parent_version": parent["version"],
        "parent_path": None if above is None else parent_path(posixpath.dirname(path), told), "properties": set_, "runs": runs,
    }


def filled(value: str, properties: dict) -> tuple[str, set[str]]:
    """value with its ``${name}`` replaced, and the names that were: what a property holds may name others; what nothing sets stays."""
    used: set[str] = set()
    for _ in range(PASSES):
        names = {n for n in re.findall(r"\$\{([^}]+)\}", value) if n in properties}
        if not names or len(value) > LONGEST:
            break
        used |= names
        for n in names:
            value = value.replace("${" + n + "}", properties[n])
    return value, used
