"""Small songs as frames: every progression is one song of one shared DataFrame."""

FRAME_SCHEMA = ("song_id string, frame_idx int, time double, duration double, beats double, bar int, section string, "
                "time_unit string, candidates array<struct<label:string,prob:double>>")


def plain(song_id: str, text: str) -> list[tuple]:
    """One chord per 4-beat bar."""
    return soft(song_id, *[[(c, 1.0)] for c in text.split()])


def soft(song_id: str, *frames: list[tuple[str, float]]) -> list[tuple]:
    return [(song_id, i, 4.0 * i, 4.0, 4.0, i + 1, None, "beat", c) for i, c in enumerate(frames)]


class Result:
    """Collected view of one song, for short assertions."""

    def __init__(self, song_id, events, segments, home, names):
        self.song_id = song_id
        self.events = sorted((e for e in events if e.song_id == song_id), key=lambda e: e.event_no)
        self.segments = sorted((s for s in segments if s.song_id == song_id), key=lambda s: s.seg)
        self.home = sorted((h for h in home if h.song_id == song_id), key=lambda h: h["rank"])
        self.names = sorted((p for p in names if p.song_id == song_id), key=lambda p: p.segs[0])

    def of(self, type_):
        return [e for e in self.events if e.type == type_]

    def labels(self, type_):
        return [e.label for e in self.of(type_)]

    def at(self, type_, seg):
        return [e for e in self.of(type_) if seg in e.segs]

    @property
    def numerals(self):
        return [s.display or "-" for s in self.segments]

    @property
    def key(self):
        from cadenza.theory import KEY_LABELS
        return KEY_LABELS[self.home[0].key_idx]
