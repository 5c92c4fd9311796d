"""Report sink: every output row says which protocol and configuration made it."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F


def provenance(protocol: dict, configs: dict[str, dict], when: datetime | None = None) -> dict[str, str]:
    """Hashes of the protocol and of each configuration, and a timestamp."""

    def sha(value: dict) -> str:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

    stamp = (when or datetime.now(timezone.utc)).isoformat(timespec="seconds")
    return {
        "protocol_sha256": sha(protocol),
        **{f"{name}_sha256": sha(value) for name, value in sorted(configs.items())},
        "generated_at": stamp,
    }


def write(df: DataFrame, path: str, source: dict[str, str], fmt: str = "parquet") -> None:
    df.select("*", *[F.lit(v).alias(k) for k, v in source.items()]).write.format(fmt).mode("overwrite").save(path)


def same_protocol(reports: list[DataFrame]) -> bool:
    """All sections must come from one protocol."""
    hashes = reports[0].select("protocol_sha256")
    for other in reports[1:]:
        hashes = hashes.unionByName(other.select("protocol_sha256"))
    # At most two values reach the driver.
    return len(hashes.distinct().limit(2).collect()) == 1
