"""Synthetic tables of any size: each row follows from its id and a seed alone, on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The inputs of the two tables, in order.
DEVICE_INPUTS = (
    "thermal_gradient", "vibration_rms", "voltage_drift", "packet_jitter", "fan_delta", "load_spike", "thermal_sensor_b", "vibration_peak",
    "voltage_backup", "latency_p95", "ambient_humidity", "queue_depth", "memory_pressure", "disk_wait", "rack_position", "firmware_age",
    "noise_probe_a", "noise_probe_b",
)
WORKLOAD_INPUTS = (
    "request_rate", "payload_kb", "cache_miss_rate", "cpu_saturation", "memory_gb", "region_distance", "request_rate_lag", "cpu_load_copy",
    "network_egress", "queue_wait", "replica_count", "cold_start_rate", "storage_iops", "weekday", "noise_meter_a", "noise_meter_b",
)
# How an input mixes others (name -> weight) with noise of its own (under ""); one that isn't listed is noise alone.
DEVICE_MIXES = {
    "thermal_sensor_b": {"thermal_gradient": 0.91, "": 0.25}, "vibration_peak": {"vibration_rms": 0.88, "": 0.29},
    "voltage_backup": {"voltage_drift": 0.86, "": 0.33}, "latency_p95": {"packet_jitter": 0.67, "load_spike": 0.45, "": 0.35},
    "ambient_humidity": {"thermal_gradient": 0.25, "": 0.9}, "queue_depth": {"load_spike": 0.52, "": 0.74},
    "memory_pressure": {"load_spike": 0.43, "": 0.82}, "disk_wait": {"load_spike": 0.25, "": 0.96},
}
WORKLOAD_MIXES = {
    "cpu_saturation": {"request_rate": 0.5, "": 0.78}, "request_rate_lag": {"request_rate": 0.9, "": 0.3}, "cpu_load_copy": {"cpu_saturation": 0.89, "": 0.31},
    "network_egress": {"payload_kb": 0.55, "request_rate": 0.32, "": 0.65}, "queue_wait": {"cpu_saturation": 0.62, "": 0.56},
    "replica_count": {"request_rate": 0.5, "": 0.7}, "cold_start_rate": {"cache_miss_rate": 0.38, "": 0.84}, "storage_iops": {"payload_kb": 0.3, "": 0.92},
}


def uniform(seed: int, name: str, ids: Column, at: int = 1) -> Column:
    """A number above 0 and up to 1 from 13 hexadecimal digits (from digit `at`) of the md5 of seed, name and id."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{name}"), ids.cast("string")))
    return (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 1) / F.lit(2.0**52)


def normal(seed: int, name: str, ids: Column) -> Column:
    """A standard normal number (Box and Muller's rule) of the name and the id."""
    return F.sqrt(-2 * F.ln(uniform(seed, name, ids))) * F.cos(F.lit(6.283185307179586) * uniform(seed, name, ids, 14))


def _mixed(ids: DataFrame, id_col: str, names: tuple[str, ...], mixes: dict, seed: int, given: dict[str, Column]) -> DataFrame:
    out = ids.select(F.col(id_col))
    for name in names:
        own = given.get(name, normal(seed, name, F.col(id_col)))
        parts = [w * (F.col(other) if other else own) for other, w in mixes.get(name, {"": 1.0}).items()]
        out = out.withColumn(name, sum(parts[1:], parts[0]))
    return out


def device_failure(ids: DataFrame, id_col: str = "id", seed: int = 17) -> DataFrame:
    """For each id 18 readings of a device (six that matter, six that repeat or mix these, and noise) and fails_within_24h (0 or
    1), drawn with a logistic probability that has an interaction. ids: for example `spark.range(n)`."""
    key = F.col(id_col)
    rows = _mixed(ids, id_col, DEVICE_INPUTS, DEVICE_MIXES, seed, {})
    # Weights of the readings, of one product of two, of noise, and the constant.
    logit = (
        1.35 * F.col("thermal_gradient") + 1.05 * F.col("vibration_rms") + 0.82 * F.col("voltage_drift") + 0.66 * F.col("packet_jitter") - 0.62 * F.col("fan_delta")
        + 0.5 * F.col("load_spike") + 0.32 * F.col("thermal_gradient") * F.col("vibration_rms") + 0.35 * normal(seed, "logit", key) - 0.15
    )
    return rows.withColumn("fails_within_24h", F.when(uniform(seed, "label", key) < 1 / (1 + F.exp(-logit)), 1).otherwise(0))


def workload_cost(ids: DataFrame, id_col: str = "id", seed: int = 29) -> DataFrame:
    """For each id 16 signals of a workload and hourly_cost_usd, a linear cost with one interaction and noise."""
    key = F.col(id_col)
    weekday = F.floor((1 - uniform(seed, "weekday", key)) * 7) / 3 - 1
    rows = _mixed(ids, id_col, WORKLOAD_INPUTS, WORKLOAD_MIXES, seed, {"weekday": weekday})
    # The constant, weights of the signals, of one product of two, and of noise.
    cost = (
        21.0 + 6.8 * F.col("request_rate") + 4.2 * F.col("payload_kb") + 3.7 * F.col("cache_miss_rate") + 5.1 * F.col("cpu_saturation") + 2.4 * F.col("memory_gb")
        + 1.9 * F.col("region_distance") + 1.2 * F.col("request_rate") * F.col("payload_kb") + 1.8 * normal(seed, "cost", key)
    )
    return rows.withColumn("hourly_cost_usd", cost)
