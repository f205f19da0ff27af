"""Record types and the task dimension."""
from __future__ import annotations

#: Fixed values of the benchmark.
VIDEO_FPS, FRAME_BUDGET, SHORT_WINDOW, SHORT_STRIDE, GROUNDING_MARGIN = 10, 64, 320, 5, 50
COORDINATE_MAX, SENTINEL_BOX, THRESHOLD = 1000, [-1.0, -1.0, -1.0, -1.0], 0.5
GROUNDING, ACTIONS, IMAGINATION = "Spatial_Temporal_Grounding", "Continuous_Actions_Caption", "Spatial_Imagination"
VARIANTS = ["language", "visual", "language_visual"]

#: Task, kind of input, payload, judge mode ("strict": four criteria, "final": the final one).
TASKS = [
    ("Scoreboard_Single", "frame", "box", "strict"),
    ("Objects_Spatial_Relationships", "frame", "objects", "strict"),
    ("Scoreboard_Multiple", "window", "text", "strict"),
    ("Spatial_Imagination", "window", "text", "strict"),
    ("Score_Prediction", "window", "text", "strict"),
    ("Temporal_Causal", "window", "text", "final"),
    ("AI_Coach", "window", "text", "final"),
    ("Continuous_Events_Caption", "window", "segments", "final"),
    ("Continuous_Actions_Caption", "window", "segments+tracking", "final"),
    ("Spatial_Temporal_Grounding", "grounding", "window+tracking", "none"),
]
CAPTIONS = ["Continuous_Actions_Caption", "Continuous_Events_Caption"]
TASK_NAMES = [t[0] for t in TASKS]
UPSTREAM_TASKS = [ACTIONS, GROUNDING]
PAYLOAD_KIND = {t[0]: t[2] for t in TASKS}


BOX = "array<double>"
TRACKING = f"array<struct<frame_sampled bigint, bbox_mot {BOX}>>"
SEGMENTS = "array<struct<start_sampled bigint, end_sampled bigint, text string>>"
OBJECTS = f"array<struct<label string, bbox {BOX}>>"
PREDICTION = f"text string, bbox {BOX}, objects {OBJECTS}, segments {SEGMENTS}, time_window_sampled array<bigint>, tracking {TRACKING}"
DECISION = "correctness int, completeness int, faithfulness int, final_pass int, confidence string, brief_reason string"
DECISION_TYPE = f"struct<{DECISION.replace(' ', ':').replace(',:', ',')}>"
