"""Fixed values.

Word lists, lookup tables, patterns and message texts whose exact content decides the results. They are data, not logic;
everything that uses them lives in ``functions`` and ``operators``.
"""

# --- severity -------------------------------------------------------------------------------------------------------
SEVERITY_ORDER = ["Low", "Medium", "High", "Critical"]
SEVERITY_WORDS = {
    "low": "Low",
    "minor": "Low",
    "medium": "Medium",
    "moderate": "Medium",
    "high": "High",
    "major": "High",
    "critical": "Critical",
    "severe": "Critical",
}
SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}
MAP_SEVERITY_RANK = {"Low": 0, "Medium": 1, "Moderate": 1, "High": 2, "Critical": 3}

# --- yes/no words ---------------------------------------------------------------------------------------------------
TRUE_WORDS = ["yes", "y", "true", "1", "reportable", "required"]
PLAIN_TRUE_WORDS = ["yes", "true", "1"]

# --- rooms ----------------------------------------------------------------------------------------------------------
KITCHEN_PATTERN = "kitchen"
BATHROOM_PATTERN = "bathroom|toilet|washroom|restroom"
BATHROOM_PATTERN_FALLBACK = "bath|toilet|washroom|restroom"

# --- reporting time frames ------------------------------------------------------------------------------------------
TIME_FRAME_HOURS = {
    "Immediate": 0,
    "Within 24 hours": 12,
    "24-48 hours": 36,
    "48-72 hours": 60,
    "More than 72 hours": 96,
}
TIME_FRAME_DEFAULT_HOURS = 24
PROMPT_TIME_FRAME_PATTERN = "24 hour|within 24|immediate"

# --- rules ----------------------------------------------------------------------------------------------------------
SERIOUS_TYPES = ["unethical behavior", "assault", "unauthorized restraints"]
ALERT_SEVERITIES = ["high", "critical", "4", "5"]
ALERT_MODERATE = ["moderate", "3"]
CAUSE_COLUMNS = ["incident_type", "contributing_factors", "cause", "root_cause"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
STAGES = [
    "All_Incidents",
    "Required_Investigation",
    "Under_Investigation",
    "Action_Complete",
    "Overdue_Actions",
    "Compliance_Breach",
]

# --- bands: (lower bound, label), first hit from the top ------------------------------------------------------------
WORKLOAD_BANDS = [
    (15, "High Volume (15+/month)"),
    (8, "Medium Volume (8-14/month)"),
    (3, "Low Volume (3-7/month)"),
    (None, "Very Low Volume (<3/month)"),
]
COMPLIANCE_BANDS = [
    (95, "Good (95-100%)"),
    (85, "Monitoring (85-94%)"),
    (70, "Needs Support (70-84%)"),
    (None, "Immediate Attention (<70%)"),
]
DELAY_BANDS = [
    (1, "Excellent (<1 day)"),
    (2, "Good (1-2 days)"),
    (3, "Needs Attention (2-3 days)"),
    (None, "Poor (>3 days)"),
]
RISK_BANDS = [(0.7, "HIGH"), (0.4, "MEDIUM"), (None, "LOW")]

# --- columns a model or a clustering must not see -------------------------------------------------------------------
LEAKY_NAME_PATTERNS = [
    "report", "reportable", "notify", "notified",
    "investigat", "severity", "medical", "outcome",
    "resolution", "timeframe", "delay", "compliance",
    "follow", "action", "result", "status", "closed",
]
CLUSTER_DROP_COLUMNS = [
    "severity", "severity_numeric", "reportable", "reportable_bin",
    "medical_attention_required", "treatment_required",
    "investigation_required", "incident_resolved",
    "notified_to_commission", "reporting_timeframe",
    "actions_documented", "medical_outcome", "report_delay_hours", "within_24h",
]
CLUSTER_DROP_PATTERNS = [
    "report", "severity", "medical", "investigat", "outcome", "timeframe", "delay", "compliance",
]

# --- places ---------------------------------------------------------------------------------------------------------
SUBURB_CENTROIDS = [
    ("SYDNEY", -33.8688, 151.2093),
    ("PARRAMATTA", -33.8136, 151.0017),
    ("LIVERPOOL", -33.9200, 150.9230),
    ("CAMPBELLTOWN", -34.0660, 150.8140),
    ("BONDI", -33.8915, 151.2767),
    ("BLACKTOWN", -33.7680, 150.9080),
    ("PENRITH", -33.7510, 150.6920),
    ("WOLLONGONG", -34.4278, 150.8931),
    ("NEWCASTLE", -32.9283, 151.7817),
    ("CHATSWOOD", -33.7960, 151.1830),
]
NAMED_PLACES = [
    ("Group Home", -33.8707, 151.2069),
    ("Transport Vehicle", -33.8688, 151.2093),
    ("Day Program", -33.8710, 151.2000),
    ("Community Access", -33.8730, 151.2050),
    ("Therapy Clinic", -33.8720, 151.2070),
    ("Care Home 1", -33.8670, 151.2100),
    ("Care Home 2", -33.8655, 151.2130),
    ("Care Home 3", -33.8620, 151.2170),
    ("Care Home 4", -33.8610, 151.2150),
    ("Care Home 5", -33.8640, 151.2190),
]
DEFAULT_CENTER = (-33.865, 151.209)
SYDNEY_BOX = (-33.95, -33.84, 151.10, 151.26)
SUBURB_PATTERN = r"(?i),\s*([A-Za-z ]+),\s*NSW\s*(\d{4})\b"
STREET_ADDRESS_PATTERN = r"\d+ [\w ]+, [\w ]+ NSW \d+"
JITTER_METRES = 250.0
METRES_PER_DEGREE = 111000.0

# --- contributing-factor labels -------------------------------------------------------------------------------------
FACTOR_PHRASES = [
    ("natural causes", "Natural causes"),
    ("no signage on wet floor", "Wet floor"),
    ("wet floor not clearly marked", "Wet floor"),
    ("trip hazard not removed", "Trip hazard"),
    ("poor lighting in certain areas", "Lighting"),
    ("gate alarm not functioning", "Gate alarm"),
    ("gate left unlatched", "Gate unlatched"),
    ("chemical storage room left open", "Chem storage"),
    ("medication tray left unattended", "Med tray"),
    ("monitoring equipment malfunction", "Monitoring"),
    ("faulty equipment", "Equipment"),
    ("incorrect use of hoist", "Hoist misuse"),
    ("battery not charged before use", "Battery flat"),
    ("vehicle not parked securely", "Vehicle"),
    ("poor vehicle maintenance", "Vehicle"),
    ("noise levels in common area", "Noise"),
    ("sensory overload in group area", "Sensory"),
    ("environmental temperature", "Temperature"),
    ("environmental stressors (noise, crowds)", "Stressors"),
    ("environmental factors (weather events)", "Weather"),
    ("environmental factors (e.g., moisture impacting electronics)", "Moisture"),
    ("wear and tear reported but not addressed", "Wear/tear"),
    ("routine maintenance not completed", "Maintenance"),
    ("lack of regular maintenance", "Maintenance"),
    ("unsecured power cables", "Cables"),
    ("sharp object within reach", "Sharp object"),
    ("care plan not followed for hygiene support", "Care plan"),
    ("lack of 1:1 supervision as per care plan", "Supervision"),
    ("inadequate monitoring as per care plan", "Monitoring"),
    ("no approved behaviour support plan in place", "No BSP"),
]
FACTOR_PATTERNS = [
    (r"\bmental (health|illness)|\banxiety|\bdepress|\bpsych", "Mental health"),
    (r"\bpalliative\b", "Palliative"),
    (r"\b(financ|expense|invoice|transaction)\b", "Finance"),
    (r"\b(1:?1|one[- ]to[- ]one|supervis|monitoring)\b", "Supervision"),
    (r"\b(fatigue|tired|low morale|long day)\b", "Fatigue"),
    (r"\bstorage\b", "Storage"),
    (r"\b(exploit|vulnerab)", "Exploitation"),
    (r"\b(routin|schedule|rostering|unstructured)\b", "Routine"),
    (r"\bhygien", "Hygiene"),
    (r"\b(access|support)\b", "Support"),
    (r"\b(underlying|existing|history).*(health|medic|illness|condition)", "Condition"),
    (r"\bisolation\b|social iso", "Isolation"),
    (r"\btrain(ing)?\b", "Training"),
    (r"\b(protocol|procedure|guideline|policy|code of conduct)\b", "Protocol"),
    (r"\bcommunicat|handover\b", "Comms"),
    (r"\bmedicat", "Medication"),
    (r"\blight(ing)?\b", "Lighting"),
    (r"\b(fault|equipment|device|hoist|battery)\b", "Equipment"),
    (r"\bmainten|wear and tear\b", "Maintenance"),
    (r"\b(vehicle|traffic)\b", "Transport"),
    (r"\b(allergen|wet floor|trip|floor|hazard|gate|unlatched|cable|sharp|alarm)\b", "Safety"),
    (r"\bbehavio(u)?r|escalation|de-?escalation|warning\b", "Behaviour"),
    (r"\bboundar", "Boundaries"),
    (r"\bbehaviou?r support plan|\bbsp\b", "BSP"),
    (r"\breport\b|notifi", "Reporting"),
    (r"\binfection|hydration\b", "Clinical"),
    (r"\belectr", "Electrical"),
    (r"\b(fire|drill|evac)\b", "Fire"),
    (r"\bvisitor\b", "Visitor"),
    (r"\bstaffing|understaff", "Staffing"),
    (r"\bndis|funding\b", "NDIS"),
    (r"\bbudget|cost\b", "Budget"),
    (r"\bdesign|layout\b", "Design"),
    (r"\b(overcrowding|noise|sensory)\b", "Noise"),
    (r"\b(diagnos|testing)\b", "Diagnosis"),
    (r"\b(deterioration|sudden medical event|symptom)\b", "Deterioration"),
]
# One of these is in every text that the pattern of the same place matches.
FACTOR_STEMS = [
    ("mental ", "anxiety", "depress", "psych"),
    ("palliative",),
    ("financ", "expense", "invoice", "transaction"),
    ("11", "1:1", "one-to", "one to", "supervis", "monitoring"),
    ("fatigue", "tired", "low morale", "long day"),
    ("storage",),
    ("exploit", "vulnerab"),
    ("routin", "schedule", "rostering", "unstructured"),
    ("hygien",),
    ("access", "support"),
    ("underlying", "existing", "history"),
    ("isolation", "social iso"),
    ("train",),
    ("protocol", "procedure", "guideline", "policy", "code of conduct"),
    ("communicat", "handover"),
    ("medicat",),
    ("light",),
    ("fault", "equipment", "device", "hoist", "battery"),
    ("mainten", "wear and tear"),
    ("vehicle", "traffic"),
    ("allergen", "trip", "floor", "hazard", "gate", "unlatched", "cable", "sharp", "alarm"),
    ("behavio", "escalation", "warning"),
    ("boundar",),
    ("behavio", "bsp"),
    ("report", "notifi"),
    ("infection", "hydration"),
    ("electr",),
    ("fire", "drill", "evac"),
    ("visitor",),
    ("staffing", "understaff"),
    ("ndis", "funding"),
    ("budget", "cost"),
    ("design", "layout"),
    ("overcrowding", "noise", "sensory"),
    ("diagnos", "testing"),
    ("deterioration", "sudden medical event", "symptom"),
]
FACTOR_TOKEN_PATTERN = r"[a-z0-9\-]+"
FACTOR_STOP_WORDS = [
    "the", "a", "an", "of", "to", "and", "or", "for", "with", "in", "on", "by", "from", "as", "per",
    "not", "no", "being", "due", "at", "its", "their", "his", "her", "is", "are", "was", "were",
    "participant", "participants", "staff", "plan", "care", "existing", "previous", "history",
    "recent", "during", "around", "about", "between", "within", "into", "across", "levels",
    "area", "areas", "group", "common", "certain", "appropriate", "specific", "latest",
]

# --- message texts --------------------------------------------------------------------------------------------------
ALERT_MESSAGE = (
    "[NDIS Early Alert] Incident %s flagged (%s). Severity: %s | Location: %s | Date: %s. "
    "Please review and escalate per SOP."
)
MITIGATIONS = {
    "basic": {
        "late": "Reinforce 24-hour notification SOP and add auto-reminders at 12 hours.",
        "self_harm": "Initiate immediate risk review and update safety plan with clinician.",
        "medication": "Run a double-check protocol refresher and update MAR audit checklist.",
        "fall": "Conduct an environment assessment and install fall-prevention aids.",
        "severe": "Escalate to on-call senior and schedule a post-incident debrief within 48 hours.",
        "default": "Log incident, review care plan triggers, and schedule targeted refresher training.",
    },
    "extended": {
        "late": "Reinforce 24-hour notification SOP and enable auto-reminders at 12 hours.",
        "self_harm": "Initiate immediate risk review and update the participant safety plan with a clinician.",
        "medication": "Run a double-check protocol refresher and update the MAR audit checklist.",
        "fall": "Conduct an environment assessment and install fall-prevention aids.",
        "severe": "Escalate to on-call senior and schedule a post-incident debrief within 48 hours.",
        "default": "Log incident, review care-plan triggers, and schedule targeted refresher training.",
    },
}
SUMMARY_CLOSING = {
    "basic": " documented the incident; follow-up actions recorded where applicable.",
    "extended": " documented the incident; follow-up actions were recorded where applicable.",
}
PROMPT_HEAD = "You are an incident-management assistant for NDIS providers.\n\nNarrative:\n"
PROMPT_CONTEXT = "\n\nContext (JSON-like):\n"
PROMPT_TASKS = (
    "\n\nTasks:\n"
    "1) Provide a concise 3–4 sentence executive summary (Australian English).\n"
    "2) Provide a prioritized bullet list (3–5) of mitigation recommendations aligned to 24-hour notification and "
    "5-day investigation SLAs.\n"
    "Be specific and actionable. Avoid PHI. Keep total under 150 words."
)
SCENARIO_RECOMMENDATIONS = {
    "Early Morning Kitchen Risk": [
        "Assign experienced carer for kitchen activities",
        "Ensure safety equipment is readily available",
        "Consider rescheduling to later hours if possible",
    ],
    "High-Risk Combination": [
        "Provide additional supervision",
        "Review recent incident patterns",
        "Consider alternative carer assignment",
    ],
    "Weekend Transport Risk": [
        "Ensure additional safety protocols",
        "Verify transport safety equipment",
        "Consider companion support",
    ],
}
DEFAULT_RECOMMENDATION = ["Review safety protocols", "Increase supervision"]
# name, hours, location_contains, day_type, participant_history, carer_history, severity
SCENARIOS = [
    ("Early Morning Kitchen Risk", [5, 6, 7, 8], "kitchen", None, ">= 3", None, "HIGH"),
    ("High-Risk Combination", None, None, None, ">= 5", ">= 10", "MEDIUM"),
    ("Weekend Transport Risk", None, "transport", "weekend", None, None, "MEDIUM"),
]
ALERT_THRESHOLDS = {"high": 0.7, "medium": 0.5, "low": 0.3}
DEFAULT_ALERT_THRESHOLD = 0.5
