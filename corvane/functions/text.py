"""Scalar text functions as column expressions; IDs F1-F19 and P4, P5, P12 of the inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query doesn't search for.
STOP_WORDS = [
    "como", "que", "quando", "qual", "quais", "uma", "para", "com", "por", "dos", "das", "seu", "sua", "são",
    "sao", "entre", "após", "apos", "the", "how", "and", "does", "with", "from", "into",
]

#: What a word of a query also searches for.
ALIASES = {
    "movimento": ["movement", "move"],
    "velocidade": ["velocity"],
    "jogador": ["player"],
    "câmera": ["camera"],
    "camera": ["camera"],
    "segue": ["follow"],
    "seguir": ["follow"],
    "segui": ["follow"],
    "zoom": ["zoom"],
    "antecipa": ["anticipation", "follow"],
    "posição": ["position"],
    "posicao": ["position"],
    "diálogo": ["dialogue"],
    "dialogo": ["dialogue"],
    "escolhas": ["choose", "choice", "option"],
    "escolha": ["choose", "choice", "option"],
    "consequências": ["apply", "effect", "result"],
    "consequencia": ["apply", "effect"],
    "estado": ["state"],
    "missão": ["mission"],
    "missao": ["mission"],
    "salvo": ["save", "persist", "persistence"],
    "salva": ["save", "persist", "persistence"],
    "salvar": ["save", "persist", "persistence"],
    "restaurado": ["load", "persistence"],
    "carregamento": ["load", "persistence"],
    "retomada": ["resume"],
    "retomado": ["resume"],
    "gravidade": ["gravity", "velocity", "compute"],
    "rota": ["route"],
    "cancela": ["cancel"],
    "vira": ["face"],
    "direção": ["direction"],
    "direcao": ["direction"],
    "ajusta": ["apply", "adjust"],
    "ajustado": ["apply", "adjust"],
    "opções": ["options"],
    "opcao": ["option"],
    "conversa": ["dialogue"],
    "pessoa": ["person"],
    "aberta": ["open"],
    "abre": ["open"],
    "confirma": ["commit"],
    "efeito": ["effect", "apply"],
    "persiste": ["persist"],
    "persistido": ["persist"],
    "vazios": ["empty"],
    "inválidos": ["corrupt"],
    "ajuste": ["adjust"],
    "começa": ["begin"],
    "comeca": ["begin"],
    "termina": ["end"],
    "escrita": ["write", "save"],
    "armazenamento": ["storage", "save"],
    "bloqueado": ["locked"],
    "exportado": ["export"],
}


def estimate_tokens(text: Column) -> Column:
    """a token for every four bytes, rounded up."""
    return ((F.octet_length(text) + 3) / 4).cast("long")


def lexical_terms(text: Column) -> Column:
    """lower-cased runs of ASCII letters, digits and other characters beyond ASCII, split where a capital follows a lower-case letter; two bytes at least."""
    split = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^0-9a-z\x{0080}-\x{10FFFF}]+"), lambda t: F.octet_length(t) >= 2)


def query_terms(text: Column) -> Column:
    """lexical terms that aren't stop words, each followed by its aliases."""
    table = F.create_map(*[x for word, more in ALIASES.items() for x in (F.lit(word), F.array(*map(F.lit, more)))])
    kept = F.filter(lexical_terms(text), lambda t: ~t.isin(*STOP_WORDS))
    return F.flatten(F.transform(kept, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))


def memory_terms(text: Column, most: int) -> Column:
    """up to ``most`` distinct lower-cased terms of 2 to 64 letters, digits and ``_./-``."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./-]+"), 0)
    return F.slice(F.array_distinct(F.filter(found, lambda t: F.length(t).between(2, 64))), 1, most)


def normalized_name(name: Column) -> Column:
    """Words split at case changes and anything but letters and digits, lower-cased, single-spaced."""
    split = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(split), "[^a-z0-9]+", " "))


def is_test_path(path: Column) -> Column:
    """Test folders, files that begin with test_, and the suffixes that languages give tests."""
    return path.rlike("/(tests?|__tests__|spec|testing)/") | path.rlike("(^|/)test_[^/]*$") | path.rlike(r"[._](test|spec)\.[^/]*$") | path.rlike(r"Tests?\.(java|kt|cs)$")


def looks_like_test_path(path: Column) -> Column:
    """P5: the looser rule of the call resolver."""
    return F.lower(path).rlike(r"/test|^tests/|[._]test\.")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """F16: the file name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"\.([^.]*)$", 1)


def bounded_context(path: Column) -> Column:
    """The first folder below src, lib or app, where two parts are left at least."""
    bare = F.regexp_replace(path, "^(src|lib|app)/", "")
    return F.when(F.size(F.split(bare, "/")) >= 2, F.substring(F.split(bare, "/")[0], 1, 128))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


#: What a line of each level holds, the most severe first.
LEVELS = (
    ("fatal", "fatal|panic"),
    ("error", "error|exception|failed|failure|can't |cannot "),
    ("warn", "warn"),
    ("debug", "debug"),
    ("trace", "trace"),
    ("info", "info|started |consumed "),
)


def log_level(line: Column) -> Column:
    """the first level whose marks the line holds."""
    out = F.lit("other")
    for level, marks in reversed(LEVELS):
        out = F.when(F.lower(line).rlike(marks), level).otherwise(out)
    return out


def normalized_message(line: Column) -> Column:
    """a line without its time and what stands before an early colon, numbers as #, 180 characters at most."""
    bare = F.trim(line)
    syslog = r"^[A-Z][a-z]{2}\s+\d+\s+\d\d:\d\d:\d\d\s+\S+\s+(?=.)"
    bare = F.when(bare.rlike(syslog), F.regexp_replace(bare, syslog, "")).otherwise(F.regexp_replace(bare, r"^(?=.{20})\d...-..-..(?=[T ])[^ ]* [^ ]* ", ""))
    bare = F.regexp_replace(bare, "^.{0,79}?: ", "")
    return truncated(F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b\d+\b", "#"), r"\s+", " ")), 180)


def content_class(text: Column) -> Column:
    """what a text is, judged by its first characters and by the marks of its first 80 lines."""
    head = F.substring(text, 1, 4096)
    control = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f]", ""))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 80), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "text")
        .when(F.contains(head, F.lit("\u0000")) | (control * 100 > F.length(head) * 5), "binary")
        .when((whole.startswith("{") & whole.endswith("}")) | (whole.startswith("[") & whole.endswith("]")), "json")
        .when(count(r"^(diff --git |@@ |\+\+\+|---)") >= 2, "diff")
        .when(count(r"(?i)^\d{4}-\d\d-\d\d[T ]|[ \[](error|warn|info)\b") >= 2, "log")
        .when(count(r"^(def |class |function |import |#include )|\) \{| => |return ") >= 1, "source")
        .when(count(r"^(# |## |```|- )") >= 2, "markdown")
        .otherwise("text")
    )


def truncated(text: Column, most: int = 200) -> Column:
    """Texts over ``most`` characters end in three dots at that length."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def canonical_fingerprint(*values: Column) -> Column:
    """C4: SHA-256 over length-prefixed values, so no two lists of values read alike."""
    parts = [F.concat(F.octet_length(v).cast("string"), F.lit(":"), v, F.lit("|")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def compact_lines(text: Column) -> Column:
    """lines without trailing white space, blank ones left out."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[ \t\r]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
