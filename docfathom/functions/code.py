"""Columns over source code: languages, imports, functions, dependencies, endpoints and calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found

# Language by file extension.
LANGUAGES = {
    "py": "python", "java": "java", "groovy": "groovy", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "cs": "csharp", "go": "go",
    "rb": "ruby", "rs": "rust", "c": "c", "cpp": "cpp", "h": "c", "sql": "sql", "sh": "shell", "yml": "yaml", "yaml": "yaml", "xml": "xml", "html": "html",
    "properties": "properties", "gradle": "gradle", "kt": "kotlin", "scala": "scala", "php": "php", "json": "json",
}

# Patterns by language: of functions, classes, imports.
FUNCTIONS = {
    "python": r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(", "javascript": r"(?m)(?:function\s+(\w+)\s*\(|(?<=const )(\w+)\s*=\s*(?:async\s*)?\()",
    "java": r"(?m)^\s*(?:public|private|protected)[\w<>\[\], ]*\s(\w+)\s*\(", "csharp": r"(?m)^\s*(?:public|private|protected|internal)[\w<>\[\], ]*\s(\w+)\s*\(",
    "go": r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(",
}
CLASSES = {k: r"(?m)^\s*(?:(?:public|abstract|export|final|sealed|partial)\s+)*(?:class|interface)\s+(\w+)" for k in ("python", "javascript", "java", "csharp")} | {"go": r"(?m)^type\s+(\w+)\s+struct"}
IMPORTS = {
    "python": r"(?m)^\s*(?:from|import)\s+([\w.]+)", "javascript": r"""(?:from\s+|require\()['"]([^'"]+)['"]""", "java": r"(?m)^import\s+(?:static\s+)?([\w.]+)",
    "csharp": r"(?m)^\s*using\s+([\w.]+)\s*;", "go": r'(?m)^\s*(?:import\s+)?"([^"]+)"',
}
ENDPOINT = r"""@(?:Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?["']([^"']+)["']|@Path\(["']([^"']+)["']\)"""
TABLES = r"(?i)\b(?:from|join|into|update|table)\s+([a-z_][\w.]*)"
URLS = r"""https?://[^\s"'<>)]+"""
QUEUES = r"""(?i)(?:queue|topic|destination)\s*=\s*["']([^"']+)["']"""
SERVICE_CALLS = r"""@FeignClient\([^)]*name\s*=\s*["']([^"']+)["']"""
MAVEN = r"(?s)<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>"
GRADLE = r"""(?m)^\s*(?:implementation|api|compile|testImplementation)\s*\(?["']([\w.-]+:[\w.-]+)"""


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ext)


def by_language(code: Column, lang: Column, patterns: dict[str, str]) -> Column:
    """Distinct matches of the language's pattern, in order of name; of alternatives the group that matched."""
    out = F.array().cast("array<string>")
    for name, pattern in patterns.items():
        groups = pattern.replace("(?:", "").replace("(?m)", "").replace("(?<", "").replace("\\(", "").count("(")
        hits = F.array_distinct(F.flatten(F.array(*[found(code, pattern, g + 1) for g in range(max(1, groups))])))
        out = F.when(lang == name, F.filter(hits, lambda h: (h != "") & h.isNotNull())).otherwise(out)
    return F.array_sort(out)


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i:(^|/)(tests?|__tests__|spec)(/|$)|(^|/)test_[^/]*$|(_test|\.test|\.spec)\.\w+$)|(Test|Tests|Spec)\.\w+$")


def parsed(code: Column, path: Column, lang: Column | None = None) -> Column:
    """One struct of everything that is found in a file; lang: its language, where a column holds it."""
    lang = language(path) if lang is None else lang
    pick = lambda p, g=1: F.array_sort(F.array_distinct(F.filter(found(code, p, g), lambda h: h != "")))
    endpoints = F.array_sort(F.array_distinct(F.filter(F.concat(found(code, ENDPOINT, 1), found(code, ENDPOINT, 2)), lambda h: h.isNotNull() & (h != ""))))
    maven = F.transform(F.arrays_zip(found(code, MAVEN, 1).alias("g"), found(code, MAVEN, 2).alias("a")), lambda d: F.concat_ws(":", d["g"], d["a"]))
    return F.struct(lang.alias("language"), F.regexp_extract(code, r"(?m)^package\s+([\w.]+)", 1).alias("package"), by_language(code, lang, IMPORTS).alias("imports"),
                    by_language(code, lang, FUNCTIONS).alias("functions"), by_language(code, lang, CLASSES).alias("classes"), endpoints.alias("endpoints"),
                    pick(SERVICE_CALLS).alias("calls"), pick(TABLES).alias("tables"), pick(URLS, 0).alias("urls"), pick(QUEUES).alias("queues"),
                    F.array_sort(F.array_distinct(F.concat(maven, found(code, GRADLE, 1)))).alias("dependencies"), is_test(path).alias("is_test"))


# Words that name nothing by themselves.
NO_EXPORTS = tuple(
    "the a an and or but if then else which that this these those is are was were be been being have has had do does did will would should could may might can must for to of in on at by from as with about "
    "into up through during before after above below between under again further once where when why how what who whom whose your our their my his her its we me him you he she it i not no nor only same so "
    "than too very just am pm get put post delete patch head options trace connect".split()
)


def valid_export(value: Column) -> Column:
    """Whether a name says anything: longer than one character, and not of words of NO_EXPORTS alone."""
    clean = F.lower(F.trim(value))
    parts = F.filter(F.split(clean, "[-_/:]"), lambda t: (t != "") & ~t.isin(*NO_EXPORTS))
    return F.coalesce((F.length(clean) > 1) & ~clean.isin(*NO_EXPORTS) & (F.size(parts) > 0), F.lit(False))


def attributes(code: Column, name: str, tag: str = r"[A-Za-z][\w:.-]*") -> Column:
    """Values of an attribute of all tags of a name (a pattern) in XML, each once, as they come; empty ones are left out."""
    inside = F.regexp_extract_all(code, F.lit(rf"<(?:{tag})(\s[^<>]*)>"), F.lit(1))
    values = F.transform(inside, lambda held: F.regexp_extract(held, rf'\s{name}\s*=\s*"([^"]*)"', 1))
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def settings(code: Column) -> Column:
    """Lines key = value as structs (key, value)."""
    lines = F.filter(F.split(code, "\n"), lambda line: F.instr(line, "=") > 0)
    return F.transform(lines, lambda line: F.struct(F.trim(F.substring_index(line, "=", 1)).alias("key"), F.trim(F.substring(line, F.instr(line, "=") + 1, F.length(line))).alias("value")))


# Words of keys that say what a setting holds, connectors that call out, and what an address may be made of.
ADDRESS_KEYS, DATABASE_KEYS, QUEUE_KEYS = ("url", "endpoint", "baseUrl"), ("jdbc", "datasource"), ("queue", "topic", "channel")
CONNECTORS = ("http", "jms", "kafka", "db")
ADDRESS = r"^[\w:/.]+"


def config(code: Column, path: Column) -> Column:
    """Struct of what Mule flows, Camel routes, beans, properties, pages and SQL scripts declare: kind, exports, endpoints, calls, services, queues, databases, service_name, service_type.

    XML is read tag by tag and settings line by line. A setting is an address if its key ends with a word of ADDRESS_KEYS and what
    follows it without a break, and it holds any value that looks like one; so is a queue's or a database's key.
    """
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    mule = path.endswith("-mule.xml") | code.contains("<mule")
    camel = ~mule & (code.contains("<route") | code.contains("<camelContext"))
    kind = F.when(ext == "xml", F.when(mule, "mule").when(camel, "camel").otherwise("xml")).when(ext.isin("properties", "yml", "yaml"), "properties").when(ext == "html", "html").when(ext == "sql", "sql").otherwise("other")
    # as the element of an array they are found once, and not for each of the fields
    once = F.array(F.struct(kind.alias("kind"), name.alias("name"), F.when(kind == "properties", settings(code)).alias("settings")))
    return F.get(F.transform(once, lambda x: _declared(code, x["kind"], x["name"], x["settings"])), F.lit(0))


def _declared(code: Column, kind: Column, name: Column, lines: Column) -> Column:
    none = F.array().cast("array<string>")
    by = lambda **of: F.array_sort(reduce(lambda out, k: F.when(kind == k, of[k]).otherwise(out), of, none))
    keyed = lambda pattern, value: F.array_distinct(F.filter(F.transform(F.filter(lines, lambda s: s["key"].rlike(pattern)), value), lambda v: v != ""))
    title = F.transform(F.regexp_extract_all(code, F.lit(r"(?i)<title[^<>]*>([^<]+)<"), F.lit(1)), lambda t: F.trim(t))
    tables = F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?i)\b(?:from|join)\s+([\w.]+)"), F.lit(1)))
    exports = by(mule=attributes(code, "name", "flow"), camel=F.transform(attributes(code, "id", "route"), lambda r: F.concat(F.lit("CamelRoute:"), r)), xml=attributes(code, "id", "bean"), html=title, sql=tables)
    ends = F.filter(attributes(code, "uri", "from|to"), valid_export)
    parts = keyed(r"^camel\.component\.[a-z0-9]+\.[a-z0-9.]+$", lambda s: F.concat(F.lit("camel-"), F.split(s["key"], r"\.")[2]))
    routes = keyed(r"^camel\.route\.[a-z0-9.]+$", lambda s: F.concat(F.lit("camel-"), F.regexp_extract(s["key"], r"^camel\.route\.(.+)$", 1)))
    outside = F.array_distinct(F.regexp_extract_all(code, F.lit(rf"<(?:{'|'.join(CONNECTORS)}):(\w+)"), F.lit(1)))
    calls = by(mule=F.array_union(outside, attributes(code, "name", "flow-ref")), camel=F.array_union(attributes(code, "ref"), attributes(code, "bean")), xml=attributes(code, "class"))
    address = keyed(rf"({'|'.join(ADDRESS_KEYS)})[.\w]*$", lambda s: F.regexp_extract(s["value"], ADDRESS, 0))
    first = lambda a: F.try_element_at(a, F.lit(1))
    service = F.when(kind == "mule", F.regexp_replace(name, "-mule$", "")).when(kind == "html", F.coalesce(first(title), name)).when(kind == "sql", F.coalesce(first(tables), name)).otherwise(name)
    spring = code.contains("camel.") | code.contains("camel:")
    return F.struct(kind.alias("kind"), exports.alias("exports"), by(mule=attributes(code, "path"), camel=ends, properties=F.array_union(parts, routes)).alias("endpoints"), calls.alias("calls"),
                    by(mule=attributes(code, "path", "http:request"), properties=address).alias("services"),
                    by(properties=keyed(rf"({'|'.join(QUEUE_KEYS)})[:\w.]*$", lambda s: s["value"])).alias("queues"), by(properties=keyed(rf"({'|'.join(DATABASE_KEYS)})[:\w.]*url$", lambda s: s["value"])).alias("databases"), service.alias("service_name"),
                    F.when(kind == "mule", "mule-flow").when(kind == "camel", "camel-xml-route").when((kind == "properties") & spring, "spring-boot-camel").when((kind == "sql") & (F.size(tables) > 0), "sql-script").alias("service_type"))


def summary(p: Column) -> Column:
    """What parsed() found in a file, in one line."""
    count = lambda a, one, many: F.when(F.size(a) > 0, F.concat(F.size(a).cast("string"), F.lit(" "), F.when(F.size(a) == 1, one).otherwise(many), F.lit(" ("), F.array_join(a, ", "), F.lit(")")))
    held = F.concat_ws(", ", count(p.classes, "class", "classes"), count(p.functions, "function", "functions"), count(p.endpoints, "endpoint", "endpoints"))
    head = F.concat(F.coalesce(p.language, F.lit("unknown")), F.when(p.is_test, " test file").otherwise(" file"), F.when(held != "", F.concat(F.lit(" with "), held)).otherwise(""))
    said = lambda a, text: F.when(F.size(a) > 0, F.concat(F.lit(text), F.array_join(a, ", ")))
    return F.concat_ws("; ", head, said(p.imports, "imports "), said(p.dependencies, "depends on "))
