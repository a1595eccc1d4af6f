"""Path columns: parts, predicates, prefixes, display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names that make a path special.
MODULE_SUFFIXES = (
    ".module.ts", ".module.tsx", ".module.js", ".module.jsx", ".module.mts", ".module.cts",
)
ROUTE_NAMES = ("route.ts", "route.tsx", "route.js", "route.jsx", "route.mts", "route.cts")
SETTINGS_NAMES = ("settings.py", "base.py", "production.py", "prod.py")
K8S_SIGNATURE = (
    r"(?m)^\s*apiVersion:\s*\S[\s\S]*?^\s*kind:\s*(?:Pod|Deployment|StatefulSet|DaemonSet"
    r"|Job|CronJob|ReplicaSet|ReplicationController)\b"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(path) -> Column:
    """Backslashes become slashes."""
    return F.replace(_col(path), F.lit("\\"), F.lit("/"))


def base_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent(path) -> Column:
    """Directory part, empty for a file at the top."""
    return F.regexp_replace(_col(path), r"/?[^/]*$", "")


def extension(path) -> Column:
    """Lower-cased extension; null when there is none. A leading dot does not start one."""
    name = base_name(path)
    dot = F.instr(F.substring(name, 2, 1 << 30), ".") > 0
    return F.when(dot, F.lower(F.substring_index(name, ".", -1)))


def segments(path) -> Column:
    return F.split(_col(path), "/")


def under_root(path, root) -> Column:
    """Component-wise prefix test; an empty root contains everything."""
    p, r = _col(path), _col(root)
    return (r == "") | (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def ancestors(path) -> Column:
    """Every directory above a path, shortest (empty) first."""
    parts = segments(path)
    return F.when(
        F.size(parts) > 1,
        F.array_distinct(F.concat(
            F.array(F.lit("")),
            F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
            ),
        )),
    ).otherwise(F.array(F.lit("")))


def short_id(sha) -> Column:
    return F.substring(_col(sha), 1, 7)


def location_text(file, line, column) -> Column:
    """``file:line:col``, ``file:line``, ``file`` or a dash."""
    f, n, c = _col(file), _col(line), _col(column)
    return (
        F.when(f.isNull(), F.lit("—"))
        .when(n.isNotNull() & c.isNotNull(), F.concat(f, F.lit(":"), n.cast("string"), F.lit(":"), c.cast("string")))
        .when(n.isNotNull(), F.concat(f, F.lit(":"), n.cast("string")))
        .otherwise(f)
    )


def is_workflow(path) -> Column:
    p = F.lower(normalize(path))
    inside = F.contains(p, F.lit("/.github/workflows/")) | F.startswith(p, F.lit(".github/workflows/"))
    return inside & F.rlike(p, F.lit(r"\.ya?ml$"))


def is_dockerfile(path) -> Column:
    return F.rlike(
        F.lower(base_name(path)), F.lit(r"^(?:dockerfile|containerfile|dockerfile\..*|.*\.dockerfile)$")
    )


def is_terraform(path) -> Column:
    return F.coalesce(extension(path).isin("tf", "tfvars"), F.lit(False))


def is_k8s(path, content) -> Column:
    """YAML that holds an ``apiVersion`` followed by a workload ``kind``; the literal keeps the pattern off other YAML."""
    head = _col(content)
    return F.coalesce(
        extension(path).isin("yaml", "yml")
        & F.contains(head, F.lit("apiVersion:"))
        & F.rlike(head, F.lit("(?d)" + K8S_SIGNATURE)),
        F.lit(False),
    )


def settings_path(path) -> Column:
    p = F.lower(normalize(path))
    return base_name(p).isin(*SETTINGS_NAMES) | F.contains(p, F.lit("/settings/"))


def is_settings(path, content) -> Column:
    """Web-framework settings file: by name, and by one of its two markers."""
    return settings_path(path) & F.rlike(
        _col(content), F.lit(r"(?d)(?m)^\s*(?:INSTALLED_APPS|MIDDLEWARE)\s*=")
    )


def is_route(path) -> Column:
    """Route handler of an application-router tree."""
    p = F.lower(normalize(path))
    return F.lower(base_name(path)).isin(*ROUTE_NAMES) & F.contains(p, F.lit("/app/"))


def is_module_file(path) -> Column:
    return F.rlike(F.lower(base_name(path)), F.lit(r"\.module\.(?:tsx?|jsx?|mts|cts)$"))
