"""Settings of a deployment, from the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Where books and audio lie, which speech service is asked, how long a request may be."""

    books_dir: str = "books"
    audio_dir: str = "audio"
    home: str = "."
    host: str = "127.0.0.1"
    port: int = 8001
    endpoint: str = ""
    max_input_chars: int = 20_000

    @property
    def service(self) -> str:
        return self.endpoint or f"http://{self.host}:{self.port}/v1"


def settings(spark: SparkSession) -> Settings:
    """Each field from ``spark.lectern.<field>``, where that is set."""
    found = {}
    for name, default in vars(Settings()).items():
        value = spark.conf.get(f"spark.lectern.{name}", None)
        if value is not None:
            found[name] = type(default)(value)
    return Settings(**found)
