"""Names of metrics and activities on the wire, classes of metrics, and the catalogue of sports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import lookup

#: Names of metrics in push payloads and their identifiers.
METRICS = {
    "heart_rate": "HKQuantityTypeIdentifierHeartRate",
    "resting_heart_rate": "HKQuantityTypeIdentifierRestingHeartRate",
    "walking_heart_rate_average": "HKQuantityTypeIdentifierWalkingHeartRateAverage",
    "heart_rate_variability": "HKQuantityTypeIdentifierHeartRateVariabilitySDNN",
    "respiratory_rate": "HKQuantityTypeIdentifierRespiratoryRate",
    "blood_oxygen_saturation": "HKQuantityTypeIdentifierOxygenSaturation",
    "body_temperature": "HKQuantityTypeIdentifierBodyTemperature",
    "apple_sleeping_wrist_temperature": "HKQuantityTypeIdentifierAppleSleepingWristTemperature",
    "breathing_disturbances": "HKQuantityTypeIdentifierAppleSleepingBreathingDisturbances",
    "headphone_audio_exposure": "HKQuantityTypeIdentifierHeadphoneAudioExposure",
    "physical_effort": "HKQuantityTypeIdentifierPhysicalEffort",
    "stair_speed_up": "HKQuantityTypeIdentifierStairAscentSpeed",
    "stair_speed_down": "HKQuantityTypeIdentifierStairDescentSpeed",
    "walking_speed": "HKQuantityTypeIdentifierWalkingSpeed",
    "walking_step_length": "HKQuantityTypeIdentifierWalkingStepLength",
    "walking_asymmetry_percentage": "HKQuantityTypeIdentifierWalkingAsymmetryPercentage",
    "walking_double_support_percentage": "HKQuantityTypeIdentifierWalkingDoubleSupportPercentage",
    "time_in_daylight": "HKQuantityTypeIdentifierTimeInDaylight",
    "dietary_water": "HKQuantityTypeIdentifierDietaryWater",
    "alcohol_consumption": "HKQuantityTypeIdentifierNumberOfAlcoholicBeverages",
    "step_count": "HKQuantityTypeIdentifierStepCount",
    "active_energy": "HKQuantityTypeIdentifierActiveEnergyBurned",
    "basal_energy_burned": "HKQuantityTypeIdentifierBasalEnergyBurned",
    "walking_running_distance": "HKQuantityTypeIdentifierDistanceWalkingRunning",
    "flights_climbed": "HKQuantityTypeIdentifierFlightsClimbed",
    "apple_exercise_time": "HKQuantityTypeIdentifierAppleExerciseTime",
    "apple_stand_time": "HKQuantityTypeIdentifierAppleStandTime",
    "apple_stand_hour": "HKCategoryTypeIdentifierAppleStandHour",
    "sleep_analysis": "HKCategoryTypeIdentifierSleepAnalysis",
    "sexual_activity": "HKCategoryTypeIdentifierSexualActivity",
}
#: The two types of a fused blood pressure point.
PRESSURE = {"systolic": "HKQuantityTypeIdentifierBloodPressureSystolic", "diastolic": "HKQuantityTypeIdentifierBloodPressureDiastolic"}
#: Display names of activities in push payloads, without the identifiers' prefix.
ACTIVITIES = {
    "Outdoor Run": "Running",
    "Indoor Run": "Running",
    "Outdoor Walk": "Walking",
    "Indoor Walk": "Walking",
    "Outdoor Cycle": "Cycling",
    "Indoor Cycle": "Cycling",
    "Hiking": "Hiking",
    "Pool Swim": "Swimming",
    "Open Water Swim": "Swimming",
    "Functional Strength Training": "FunctionalStrengthTraining",
    "Traditional Strength Training": "TraditionalStrengthTraining",
    "Core Training": "CoreTraining",
    "Yoga": "Yoga",
    "Elliptical": "Elliptical",
    "Rowing": "Rowing",
    "Stair Stepper": "StairClimbing",
    "High Intensity Interval Training": "HighIntensityIntervalTraining",
    "HIIT": "HighIntensityIntervalTraining",
    "Cooldown": "Cooldown",
    "Mind and Body": "MindAndBody",
    "Other": "Other",
}
#: Pattern, group, family and better direction of metrics; the first that an identifier holds counts.
CLASSES = [
    ("HeartRateVariability", "heart", "heart", "higher-better"),
    ("HeartRateRecovery", "heart", "heart", "higher-better"),
    ("RestingHeartRate|WalkingHeartRateAverage", "heart", "heart", "lower-better"),
    ("(High|Low|IrregularHeartRhythm)(HeartRate)?Event", "heart", "heart", "lower-better"),
    ("AtrialFibrillation", "heart", "heart", "lower-better"),
    ("BloodPressure", "heart", "heart", "neutral"),
    ("HeartRate|Cardio", "heart", "heart", "neutral"),
    ("VO2Max", "heart", "heart", "higher-better"),
    ("OxygenSaturation", "respiratory", "water", "higher-better"),
    ("RespiratoryRate|ForcedVital|PeakExpiratory", "respiratory", "water", "neutral"),
    ("Sleep", "sleep", "sleep", "neutral"),
    ("DietaryWater", "nutrition", "water", "higher-better"),
    ("DietaryEnergyConsumed", "nutrition", "energy", "neutral"),
    ("AlcoholicBeverages|BloodAlcohol", "nutrition", "neutral", "lower-better"),
    ("Dietary", "nutrition", "neutral", "neutral"),
    ("SoundReduction", "audio", "neutral", "higher-better"),
    ("Headphone", "audio", "neutral", "lower-better"),
    ("Audio|Sound", "audio", "neutral", "lower-better"),
    ("WalkingSteadiness", "mobility", "activity", "higher-better"),
    ("WalkingAsymmetry|DoubleSupport", "mobility", "activity", "lower-better"),
    ("WalkingSpeed|WalkingStepLength", "mobility", "activity", "higher-better"),
    ("Stair(Ascent|Descent)Speed", "mobility", "activity", "higher-better"),
    ("SixMinuteWalkTest", "mobility", "activity", "higher-better"),
    ("BodyFatPercentage", "body", "water", "lower-better"),
    ("LeanBodyMass", "body", "water", "higher-better"),
    ("BodyMassIndex", "body", "water", "lower-better"),
    ("BodyMass|WaistCircumference", "body", "water", "lower-better"),
    ("Height", "body", "water", "neutral"),
    ("BodyTemperature|BasalBodyTemperature", "body", "water", "neutral"),
    ("StepCount", "activity", "activity", "higher-better"),
    ("FlightsClimbed", "activity", "activity", "higher-better"),
    ("BasalEnergyBurned", "activity", "energy", "neutral"),
    ("EnergyBurned", "activity", "energy", "higher-better"),
    ("AppleExerciseTime|AppleMoveTime", "activity", "activity", "higher-better"),
    ("AppleStand", "activity", "activity", "higher-better"),
    ("EffortScore|PhysicalEffort", "activity", "energy", "neutral"),
    ("DistanceCycling|CyclingCadence|CyclingPower|CyclingSpeed|CyclingFunctionalThreshold", "activity", "distance", "neutral"),
    ("Rowing", "activity", "distance", "neutral"),
    ("Swimming|UnderwaterDepth|WaterTemperature", "activity", "water", "neutral"),
    ("RunningPower", "activity", "power", "neutral"),
    ("Running|Nike", "activity", "activity", "neutral"),
    ("Distance", "activity", "activity", "higher-better"),
    ("TimeInDaylight", "other", "neutral", "higher-better"),
    ("Mindful", "other", "sleep", "higher-better"),
]
#: Identifiers whose direction is another than their rule's.
DIRECTIONS = {
    "HKQuantityTypeIdentifierRunningGroundContactTime": "lower-better",
    "HKQuantityTypeIdentifierRunningVerticalOscillation": "lower-better",
    "HKQuantityTypeIdentifierAppleSleepingBreathingDisturbances": "lower-better",
    "HKDataTypeSleepDurationGoal": "neutral",
    "HKQuantityTypeIdentifierDistanceWalkingRunning": "higher-better",
    "HKCategoryTypeIdentifierAppleStandHour": "neutral",
}
#: The order of groups in the catalogue.
GROUPS = ("heart", "respiratory", "body", "activity", "mobility", "sleep", "nutrition", "audio", "other")
#: Label and family of each sport.
SPORTS = {
    "Running": ("Running", "activity"),
    "Cycling": ("Cycling", "distance"),
    "TraditionalStrengthTraining": ("Strength training", "power"),
    "Rowing": ("Rowing", "water"),
    "MindAndBody": ("Mind and body", "sleep"),
    "Yoga": ("Yoga", "sleep"),
    "Walking": ("Walking", "neutral"),
    "Hiking": ("Hiking", "activity"),
    "CrossTraining": ("Cross-training", "heart"),
    "HighIntensityIntervalTraining": ("HIIT", "heart"),
    "Tennis": ("Tennis", "energy"),
    "Badminton": ("Badminton", "energy"),
    "Soccer": ("Soccer", "activity"),
    "Swimming": ("Swimming", "water"),
    "MixedCardio": ("Mixed cardio", "heart"),
    "DownhillSkiing": ("Downhill skiing", "distance"),
    "CardioDance": ("Cardio dance", "energy"),
    "PaddleSports": ("Paddle sports", "water"),
    "StairClimbing": ("Stair climbing", "activity"),
    "Elliptical": ("Elliptical", "activity"),
    "Cooldown": ("Cooldown", "sleep"),
    "CoreTraining": ("Core training", "power"),
    "Other": ("Other", "neutral"),
}


def metric_identifier(name: Column) -> Column:
    """The identifier of a push metric; null for unknown names."""
    return lookup(METRICS, name)


def activity(name: Column) -> Column:
    """The activity of a push workout's display name; Other for unknown names."""
    return F.coalesce(lookup(ACTIVITIES, name), F.lit("Other"))


def _first_class(identifier: Column, part: int, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for row in reversed(CLASSES):
        out = F.when(identifier.rlike(row[0]), row[part]).otherwise(out)
    return out


def metric_group(identifier: Column) -> Column:
    """The group of a metric by the first rule that fits, else other."""
    return _first_class(identifier, 1, "other")


def metric_family(identifier: Column) -> Column:
    """The family of a metric by the first rule that fits, else neutral."""
    return _first_class(identifier, 2, "neutral")


def better(identifier: Column) -> Column:
    """higher-better, lower-better or neutral."""
    return F.coalesce(lookup(DIRECTIONS, identifier), _first_class(identifier, 3, "neutral"))


def group_rank(group: Column) -> Column:
    """Place of a group in the catalogue; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, GROUPS)), group)
    return F.when(at > 0, at).otherwise(len(GROUPS) + 1)


def label(identifier: Column) -> Column:
    """An identifier as words: prefix off, camel case split, first letter large."""
    core = F.regexp_replace(identifier, r"^HK(?:Quantity|Category)TypeIdentifier", "")
    words = F.lower(F.regexp_replace(core, r"(?<=[a-z0-9])(?=[A-Z])", " "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 10_000))


def slug(identifier: Column) -> Column:
    """An identifier as a path: prefix off, camel case split by hyphens, lower case."""
    core = F.regexp_replace(identifier, r"^HK(?:Quantity|Category)TypeIdentifier", "")
    return F.lower(F.regexp_replace(core, r"(?<=[a-z0-9])(?=[A-Z])", "-"))


def sport_label(name: Column) -> Column:
    """The label of a sport; unknown ones are written as they are, without the prefix."""
    core = F.regexp_replace(name, "^HKWorkoutActivityType", "")
    return F.coalesce(lookup({k: v[0] for k, v in SPORTS.items()}, core), core)


def sport_family(name: Column) -> Column:
    core = F.regexp_replace(name, "^HKWorkoutActivityType", "")
    return F.coalesce(lookup({k: v[1] for k, v in SPORTS.items()}, core), F.lit("neutral"))
