"""pulseframe: telemetry analytics as Spark DataFrame operators."""

from pulseframe.model import GatewayConfig

__all__ = ["GatewayConfig"]
