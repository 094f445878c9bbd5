"""Thresholds of the detectors, as frozen presets that enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Silence:
    min_gap: float = 0.35
    pad: float = 0.12
    sentence_pause: float = 0.5
    bridge: float = 1.0
    sustained: float = 0.3
    max_word: float = 0.8
    least: float = 0.02


@dataclass(frozen=True)
class Fillers:
    enabled: bool = True
    # Tokens and phrases that are removed as fillers.
    lexicon: tuple[str, ...] = ("um", "uh", "uhm", "erm", "er", "ah", "mmm", "hmm")
    ambiguous: tuple[str, ...] = ("like", "so", "right", "basically", "actually", "literally")
    phrases: tuple[tuple[str, ...], ...] = (("you", "know"), ("i", "mean"), ("sort", "of"), ("kind", "of"))
    max_duration: float = 0.6
    pause: float = 0.25


# Function words that do not count as content.
STOP_WORDS = (
    "a an the is was are were be been am to of in on at for with as and but so i you we it that this do does did um uh"
).split()


@dataclass(frozen=True)
class Retakes:
    enabled: bool = True
    n: int = 4
    window: float = 15.0
    pause: float = 0.2
    overlap: float = 0.6
    min_words: int = 2
    horizon: float = 45.0
    ceiling: float = 0.35
    confidence: float = 0.6
    chunk: int = 220
    step: int = 190
    least_words: int = 8


@dataclass(frozen=True)
class PunchIns:
    enabled: bool = True
    levels: tuple[float, ...] = (1.0, 1.12)
    min_hold: float = 2.5
    min_segment: float = 1.2


@dataclass(frozen=True)
class Voice:
    enabled: bool = True
    threshold: float = 0.5
    max_shift: float = 1.0


@dataclass(frozen=True)
class Captions:
    """How captions are timed and how a renderer draws them; colours are #RRGGBB or #RRGGBBAA,
    null for none."""

    enabled: bool = True
    max_words: int = 4
    max_chars: int = 22
    line_gap: float = 0.4
    visible: float = 0.5
    pop: float = 0.09
    offset: float = 0.0
    review: float = 0.5
    font: str = "Arial Black"
    size: int = 82
    text: str = "#FFFFFF"
    highlight: str = "#FFD44A"
    outline: int = 8
    outline_colour: str = "#000000"
    shadow: int = 4
    shadow_colour: str = "#00000099"
    uppercase: bool = False
    position: str = "bottom"
    margin: int = 420
    active_text: str | None = None
    active_box: str | None = None
    line_box: str | None = None
    box_padding: int = 14
    box_radius: int = 18
    glow: int = 0
    pop_scale: float = 1.14


# What each named look changes.
STYLES: dict[str, dict] = {
    "classic": {},
    "hormozi": {"font": "Anton-Regular", "size": 96, "uppercase": True, "outline": 10, "shadow": 6, "max_words": 3, "pop": 0.0},
    "pill": {"font": "Montserrat-ExtraBold", "active_box": "#7C3AED", "active_text": "#FFFFFF", "highlight": "#FFFFFF", "outline": 4, "pop_scale": 1.06},
    "minimal": {"font": "Montserrat-SemiBold", "size": 64, "outline": 2, "shadow": 3, "highlight": "#FFFFFF", "pop": 0.0},
    "boxed": {"font": "Montserrat-ExtraBold", "size": 72, "line_box": "#000000B3", "outline": 0, "shadow": 0, "max_words": 5, "max_chars": 28},
    "neon": {"font": "BebasNeue-Regular", "size": 110, "uppercase": True, "outline_colour": "#22D3EE", "outline": 4, "glow": 18, "highlight": "#67E8F9", "position": "centre", "shadow": 0},
}


@dataclass(frozen=True)
class Reframe:
    width: int = 1080
    height: int = 1920
    fps: float = 4.0
    smoothing: float = 0.12
    dead_zone: float = 0.06
    detection_rate: float = 0.6
    bias: float = 0.42
    enabled: bool = True


@dataclass(frozen=True)
class Encode:
    crf: int = 20
    preset: str = "veryfast"
    audio_bitrate: str = "192k"
    loudness: float = -14.0
    intermediate_crf: int = 16


@dataclass(frozen=True)
class Preset:
    name: str = "default"
    silence: Silence = field(default_factory=Silence)
    fillers: Fillers = field(default_factory=Fillers)
    retakes: Retakes = field(default_factory=Retakes)
    punch_ins: PunchIns = field(default_factory=PunchIns)
    captions: Captions = field(default_factory=Captions)
    reframe: Reframe = field(default_factory=Reframe)
    voice: Voice = field(default_factory=Voice)
    encode: Encode = field(default_factory=Encode)
    holes: float = 0.8
    min_segment: float = 0.25
    relax: float = 0.25
    review_min_pause: float = 1.0
    part_pause: float = 0.35
    wordless: float = 1.0
    budget: float = 0.6

    def styled(self, name: str) -> Preset:
        """The same edit in a named look: what moves a caption in time stays."""
        if name not in STYLES:
            raise ValueError(f"unknown caption style {name!r}; there are {', '.join(STYLES)}")
        now = self.captions
        return replace(self, captions=Captions(enabled=now.enabled, visible=now.visible, offset=now.offset, review=now.review, **STYLES[name]))


DEFAULT = Preset()
PRESETS = {
    "default": DEFAULT,
    "gentle": replace(DEFAULT, name="gentle", silence=Silence(min_gap=0.6), fillers=Fillers(enabled=False), retakes=Retakes(enabled=False)),
    "aggressive": replace(DEFAULT, name="aggressive", silence=Silence(min_gap=0.22, pad=0.06, sentence_pause=0.3), retakes=Retakes(ceiling=0.45)),
}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]
