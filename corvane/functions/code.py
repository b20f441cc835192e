"""Source code as text: comments, signatures, skeletons, symbols, data flow.

Character and syntax state can't be said in built-in functions, so these are plain functions over one file's
text; the operators below run them over Arrow batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTES = "\"'`"


def without_comments(code: str, hashes: bool = False) -> str:
    """``code`` without // and /* */ comments (and # ones); strings and their escapes are left alone, newlines stay."""
    pattern = r"""("(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|//[^\n]*|/\*.*?(?:\*/|\Z)""" + (r"|\#[^\n]*" if hashes else "")
    return re.sub(pattern, lambda m: m[1] if m[1] is not None else "\n" * m[0].count("\n"), code, flags=re.DOTALL)


def parameters(signature: str) -> list[str]:
    """The parameters of the first parenthesis, split at commas outside brackets and quotes."""
    at = signature.find("(")
    if at < 0:
        return []
    depth, quote, parts, last = 0, "", [], at + 1
    for i in range(at, len(signature)):
        c = signature[i]
        if quote:
            quote = "" if c == quote and signature[i - 1] != "\\" else quote
        elif c in QUOTES:
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}>" and not signature[i - 1 : i + 1] == "->" and not signature[i - 1 : i + 1] == "=>":
            depth -= 1
            if not depth:
                parts.append(signature[last:i])
                break
        elif c == "," and depth == 1:
            parts.append(signature[last:i])
            last = i + 1
    return [p.strip() for p in parts if p.strip()]


def arity(signature: str) -> int:
    """how many arguments a call passes; a leading self or cls isn't one. -1 without parentheses."""
    if "(" not in signature:
        return -1
    names = parameters(signature)
    return len(names) - bool(names and re.match(r"(self|cls)\b", names[0]))


BRACED = re.compile(r"^\s*(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|pub\s+|default\s+)*(?:(class|interface|struct|enum|trait|impl|function|fn|func|def|type)\s+([A-Za-z_]\w*)|(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\()")
KINDS = {"fn": "function", "func": "function", "def": "function"}
IMPORT = re.compile(r"""^\s*(?:import\s+(?:.*?\sfrom\s+)?["']([^"']+)["']|.*?\brequire\(["']([^"']+)["']\)|\#include\s+["<]([^">]+)[">]|use\s+([\w:]+)|import\s+([\w.]+);?\s*$)""")
CALL = re.compile(r"(?:\b([A-Za-z_]\w*)\s*(?:\.|::|->)\s*)?\b([A-Za-z_]\w*)\s*\(([^()]*)\)?")
NO_CALL = {"if", "for", "while", "switch", "return", "catch", "function", "fn", "func", "def", "class", "sizeof", "elif", "with", "and", "or", "not", "in"}


def parsed_python(code: str) -> tuple[list, list, list]:
    """(name, kind, start, end, signature), specifiers and (callee, qualifier, arguments, line), by the syntax tree."""
    tree = ast.parse(code)
    lines, symbols, imports, calls = code.split("\n"), [], [], []

    def visit(node: ast.AST, inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside_class else "function"
                symbols.append((child.name, kind, child.lineno, child.end_lineno, lines[child.lineno - 1].strip()))
            elif isinstance(child, ast.Import):
                imports.extend(a.name for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append("." * child.level + (child.module or ""))
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "")
                owner = f.value.id if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else ""
                if name:
                    calls.append((name, owner, len(child.args) + len(child.keywords), child.lineno))
            visit(child, isinstance(child, ast.ClassDef))

    visit(tree, False)
    return symbols, imports, calls


def parsed_braced(code: str) -> tuple[list, list, list]:
    """The same for languages with braces, by line patterns; a symbol ends where its braces close."""
    bare = without_comments(code)
    lines, symbols, imports, calls = bare.split("\n"), [], [], []
    for n, line in enumerate(lines, 1):
        if m := IMPORT.match(line):
            imports.append(next(g for g in m.groups() if g))
        if m := BRACED.match(line):
            depth, end, opened = 0, n, False
            for k in range(n - 1, len(lines)):
                depth += lines[k].count("{") - lines[k].count("}")
                opened |= "{" in lines[k]
                end = k + 1
                if opened and depth <= 0 or not opened and ";" in lines[k]:
                    break
            symbols.append((m[2] or m[3], KINDS.get(m[1] or "fn", m[1]), n, end, line.strip()))
        for m in CALL.finditer(line):
            if m[2] not in NO_CALL and not re.search(rf"\b(?:function|fn|func|def|class)\s+{m[2]}\s*$", line[: m.end(2)]):
                calls.append((m[2], m[1] or "", len([a for a in m[3].split(",") if a.strip()]), n))
    return symbols, imports, calls


def parsed(path: str, code: str) -> tuple[list, list, list]:
    """S3: a file's symbols, imports and calls. Python that doesn't parse has none."""
    if path.endswith(".py"):
        try:
            return parsed_python(code)
        except (SyntaxError, ValueError):
            return [], [], []
    return parsed_braced(code)


def skeleton(path: str, code: str) -> str:
    """the signatures of a file, in order, indented as they are nested."""
    out, open_ends = [], []
    for _, _, start, end, signature in sorted(parsed(path, code)[0], key=lambda s: (s[2], -s[3])):
        open_ends = [e for e in open_ends if e >= start]
        out.append("  " * len(open_ends) + signature.rstrip("{ ").rstrip(":"))
        open_ends.append(end)
    return "\n".join(out)


SOURCE = re.compile(r"\b(?:req|request|ctx|event)\s*\.\s*(?:body|query|params|headers|cookies)\b")
SINK = re.compile(r"\b((?:db|pool|client|conn)\s*\.\s*(?:query|execute|run)|eval|exec|res\s*\.\s*(?:send|redirect)|fs\s*\.\s*writeFile\w*|fetch)\s*\(([^;]*)")
ASSIGN = re.compile(r"^\s*(?:const|let|var)?\s*(\{[^}]*\}|[A-Za-z_]\w*)\s*=(?!=)\s*(.+?);?\s*$")


def traced(body: str) -> tuple[str, str]:
    """(status, sink) of a function's body: confirmed if what a request holds reaches a sink by plain assignments.

    A value that passes through a branch, a dynamic property or another function on its way leaves it unknown.
    """
    tainted: dict[str, bool] = {}  # name: surely
    depth, found = 0, ("none", "")
    for line in without_comments(body).split("\n"):
        text = line.strip()
        if m := SINK.search(text):
            used = [sure for name, sure in tainted.items() if re.search(rf"\b{re.escape(name)}\b", m[2])]
            direct = bool(SOURCE.search(m[2]))
            if used or direct:
                sure = (direct or all(used)) and not depth and not re.search(r"\[\w+\]|\w+\(", m[2])
                found = ("confirmed" if sure else "unknown", re.sub(r"\s", "", m[1])) if found[0] != "confirmed" else found
        elif m := ASSIGN.match(text):
            value = m[2]
            names = [n.split(":")[-1].strip() for n in m[1].strip("{}").split(",") if n.strip()]
            carried = [sure for name, sure in tainted.items() if re.search(rf"\b{re.escape(name)}\b", value)]
            if SOURCE.search(value) or carried:
                sure = all(carried) and not depth and not re.search(r"\[\w+\]|\w+\s*\(|\?", value)
                for name in names:
                    tainted[name] = sure
            elif not depth:
                for name in names:
                    tainted.pop(name, None)
        depth += bool(re.match(r"(?:\}\s*)?(?:if|else|for|while|switch|try|catch)\b.*\{\s*$", text)) - bool(re.match(r"\}", text) and depth > 0)
    return found


def parse_files(files: DataFrame) -> DataFrame:
    """(id, path, symbols, imports, calls, skeleton) of (id, path, content); one narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [parsed(p, c or "") for p, c in zip(batch.path, batch.content)]
            yield pd.DataFrame({
                "id": batch.id, "path": batch.path,
                "symbols": [[dict(zip(("name", "kind", "start_line", "end_line", "signature"), s)) for s in e[0]] for e in each],
                "imports": [e[1] for e in each],
                "calls": [[dict(zip(("callee", "qualifier", "arguments", "line"), c)) for c in e[2]] for e in each],
                "skeleton": [skeleton(p, c or "") for p, c in zip(batch.path, batch.content)],
            })

    return files.select("id", "path", "content").mapInPandas(run, "id long, path string, symbols array<struct<name:string,kind:string,start_line:int,end_line:int,signature:string>>, imports array<string>, calls array<struct<callee:string,qualifier:string,arguments:int,line:int>>, skeleton string")


def stripped(files: DataFrame, hashes: bool = False) -> DataFrame:
    """(id, content) without comments; one narrow pass."""

    @F.pandas_udf("string")
    def strip(code: pd.Series) -> pd.Series:
        return code.map(lambda c: None if c is None else without_comments(c, hashes))

    return files.select("id", strip("content").alias("content"))


def traces(functions: DataFrame) -> DataFrame:
    """(id, status, sink) of function bodies (id, body)."""

    @F.pandas_udf("status string, sink string")
    def trace(body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([traced(b or "") for b in body], columns=["status", "sink"])

    return functions.select("id", trace("body").alias("t")).select("id", "t.status", "t.sink")
