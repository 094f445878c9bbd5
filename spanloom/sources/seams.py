"""What lies outside the engine: recognisers, voice and language models, encoders, publishers.

Each is a protocol with a deterministic stand-in; plans call them through mapInPandas or take
their results as tables. Nothing here opens a connection.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.intervals import KEY


class Transcriber(Protocol):
    def transcribe(self, samples: np.ndarray, rate: int) -> list[tuple[str, float, float, float]]: ...


class VoiceModel(Protocol):
    def probabilities(self, samples: np.ndarray, window: int) -> np.ndarray: ...


class RetakeModel(Protocol):
    def propose(self, prompt: str) -> list[dict]: ...


class Publisher(Protocol):
    def publish(self, path: str, caption: str) -> dict: ...


class ToneTranscriber:
    """A word for each second that is not silent."""

    def transcribe(self, samples: np.ndarray, rate: int) -> list[tuple[str, float, float, float]]:
        out = []
        for k in range(len(samples) // rate):
            part = samples[k * rate : (k + 1) * rate]
            if np.abs(part).mean() > 0.01:
                out.append((f"w{int(1000 * np.abs(part).mean())}", float(k), float(k + 1), 0.9))
        return out


class EnergyVoice:
    """Voice where a window's level is over a floor."""

    def probabilities(self, samples: np.ndarray, window: int) -> np.ndarray:
        whole = samples[: len(samples) // window * window].reshape(-1, window)
        return np.clip(np.sqrt((whole**2).mean(1)) * 4, 0, 1).astype(np.float32)


class NoModel:
    def propose(self, prompt: str) -> list[dict]:
        return []


class RecordingPublisher:
    """Answers with an id made of what it was given; keeps nothing."""

    limit = 2200

    def publish(self, path: str, caption: str) -> dict:
        return {"media_id": hashlib.sha256(path.encode()).hexdigest()[:16], "caption": caption[: self.limit], "status": "published"}


TRANSCRIBERS: dict[str, type] = {"tone": ToneTranscriber}


def transcriber(name: str) -> Transcriber:
    if name not in TRANSCRIBERS:
        raise ValueError(f"unknown transcriber {name!r}; there are {', '.join(sorted(TRANSCRIBERS))}")
    return TRANSCRIBERS[name]()


def publisher(explicit: str | None, keyed: bool) -> str:
    """The named backend if there is one, else the keyed service, else the direct one."""
    return explicit or ("service" if keyed else "direct")


def transcribed(audio: DataFrame, name: str, rate: int) -> DataFrame:
    """Words of packed signals (media_id, samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = transcriber(name)
        for p in batches:
            rows = [(m, i, *w) for m, s in zip(p[KEY], p["samples"]) for i, w in enumerate(model.transcribe(np.asarray(s, float), rate))]
            yield pd.DataFrame(rows, columns=[KEY, "idx", "text", "start", "end", "probability"])

    return audio.select(KEY, "samples").mapInPandas(run, f"{KEY} long, idx long, text string, start double, end double, probability double")


def voiced(audio: DataFrame, window: int = 512) -> DataFrame:
    """Voice probabilities of packed signals, an array per media."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = EnergyVoice()
        for p in batches:
            yield pd.DataFrame({KEY: p[KEY], "probs": [model.probabilities(np.asarray(s, float), window) for s in p["samples"]]})

    return audio.select(KEY, "samples").mapInPandas(run, f"{KEY} long, probs array<float>")


def published(videos: DataFrame) -> DataFrame:
    """One answer per video (media_id, path, caption); a failure is that row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = RecordingPublisher()
        for p in batches:
            rows = []
            for m, path, caption in zip(p[KEY], p["path"], p["caption"]):
                try:
                    a = backend.publish(path, caption or "")
                    rows.append((m, a["status"], a["media_id"], a["caption"], None))
                except Exception as e:  # one bad video does not stop the others
                    rows.append((m, "error", None, caption, str(e)))
            yield pd.DataFrame(rows, columns=[KEY, "status", "remote_id", "caption", "error"])

    return videos.select(KEY, "path", "caption").mapInPandas(run, f"{KEY} long, status string, remote_id string, caption string, error string")
