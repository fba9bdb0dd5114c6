"""Explicit schemas of the catalogue's JSON documents."""

STEM = "struct<gain: double, pan: double, muted: boolean, soloed: boolean>"
EDIT = "struct<mode: string, startSeconds: double, endSeconds: double, label: string>"
REGION = "struct<id: string, label: string, startSeconds: double, endSeconds: double>"
MARKER = "struct<id: string, label: string, startSeconds: double, endSeconds: double, origin: string>"
PRACTICE = (
    "struct<trackNotes: string, positionSeconds: double, playbackRate: double, pitchSemitones: double, volume: double, "
    "loopEnabled: boolean, loopASeconds: double, loopBSeconds: double, metronomeEnabled: boolean, metronomeVolume: double, "
    "beatThisDbn: boolean, beatSubdivisionMode: string, trainerEnabled: boolean, trainerStartRate: double, "
    "trainerRepetitions: int, trainerIncrement: double, trainerTargetRate: double, "
    f"chordEdits: array<{EDIT}>, chordTimelines: array<struct<mode: string, regions: array<{REGION}>>>, markers: array<{MARKER}>, "
    f"stemsEnabled: boolean, lastStemProfile: string, stemMix: array<{STEM}>, stemNames: array<string>>"
)
TRACK = (
    "struct<id: string, title: string, sourcePath: string, originalSourcePath: string, format: string, fileSizeBytes: bigint, "
    f"durationSeconds: double, sampleRate: int, channels: int, practice: {PRACTICE}>"
)
MANIFEST = (
    f"formatVersion int, id string, name string, createdAt timestamp, updatedAt timestamp, tracks array<{TRACK}>, _corrupt string"
)
TIMED_CHORD = (
    "struct<label: string, sourceLabel: string, startSeconds: double, endSeconds: double, bass: string, strength: double>"
)
WORKER_RESULT = (
    "struct<modelVersion: string, downbeatModelVersion: string, bpm: double, beats: array<double>, downbeats: array<double>, "
    "dbnBpm: double, dbnBeats: array<double>, dbnDownbeats: array<double>, "
    f"modes: map<string, array<{TIMED_CHORD}>>, warnings: array<string>>"
)
FORMAT_VERSION = 1
MAX_MANIFEST_BYTES = 8 * 1024 * 1024
# Defaults of settings a manifest may leave out.
PRACTICE_DEFAULTS = {
    "trackNotes": "", "positionSeconds": 0.0, "playbackRate": 1.0, "pitchSemitones": 0.0, "volume": 0.8, "loopEnabled": True,
    "metronomeEnabled": False, "metronomeVolume": 0.55, "beatSubdivisionMode": "auto", "trainerEnabled": False,
    "trainerStartRate": 0.5, "trainerRepetitions": 1, "trainerIncrement": 0.05, "trainerTargetRate": 1.0, "stemsEnabled": False,
}
