"""Options for tables in a database, from the environment."""

from __future__ import annotations

from collections.abc import Mapping


def jdbc_options(env: Mapping[str, str], prefix: str = "DB") -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``: DATABASE_URL as it is, or built from host, user and password.

    The error names every variable that is missing, not only the first. Port and name have defaults.
    """
    url = (env.get("DATABASE_URL") or "").strip()
    if url:
        return {"url": url if url.startswith("jdbc:") else f"jdbc:{url}"}
    names = {k: f"{prefix}_{k.upper()}" for k in ("host", "user", "password")}
    missing = [v for v in names.values() if not env.get(v)]
    if missing:
        raise ValueError("no database is configured: give DATABASE_URL or set " + ", ".join(missing))
    port, name = env.get(f"{prefix}_PORT") or "5432", env.get(f"{prefix}_NAME") or "postgres"
    return {"url": f"jdbc:postgresql://{env[names['host']]}:{port}/{name}", "user": env[names["user"]], "password": env[names["password"]]}
