"""Race result status taxonomy as lookup rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Result statuses by group, in the order in which groups win.
CRASH = ["Collision", "Accident", "Spun off", "Collision damage", "Debris", "Fatal accident", "Fire"]
FUEL = ["Out of fuel", "Fuel", "Fuel system", "Fuel pump", "Fuel leak", "Fuel pipe", "Fuel rig", "Fuel pressure"]
ADMIN = ["Disqualified", "Retired", "Withdrew", "Not classified", "107% Rule", "Safety", "Did not qualify", "Did not prequalify",
         "Excluded", "Not restarted", "Underweight", "Safety belt"]
HEALTH = ["Injured", "Injury", "Driver unwell", "Illness", "Physical", "Eye injury", "Safety concerns"]
MECHANICAL = {
    "powertrain": ["Transmission", "Gearbox", "Clutch", "Drivetrain", "Differential", "Halfshaft", "Driveshaft", "CV joint"],
    "engine": ["Engine", "Engine misfire", "Turbo", "Supercharger", "Power Unit"],
    "ers": ["ERS"],
    "brakes": ["Brakes", "Brake duct"],
    "wheels_tyres": ["Tyre", "Tyre puncture", "Puncture", "Wheel", "Wheel nut", "Wheel rim", "Wheel bearing"],
    "suspension_chassis": ["Suspension", "Chassis", "Undertray"],
    "cooling": ["Radiator", "Cooling system"],
    "electrical": ["Electrical", "Electronics", "Battery", "Ignition", "Magneto"],
    "oil_system": ["Oil leak", "Oil pressure", "Oil line", "Oil pump", "Oil pipe"],
    "water_system": ["Water leak", "Water pressure", "Water pump", "Water pipe"],
    "aero_bodywork": ["Front wing", "Rear wing", "Broken wing"],
    "mechanical_other": [
        "Hydraulics", "Overheating", "Mechanical", "Driver Seat", "Refuelling", "Throttle", "Steering", "Technical", "Heat shield fire",
        "Exhaust", "Track rod", "Pneumatics", "Engine fire", "Launch control", "Crankshaft", "Alternator", "Injection", "Distributor",
        "Spark plugs", "Axle", "Seat", "Damage"],
}
# Families whose members keep their own name as sub-family, and members that share one.
OWN_NAME = {"powertrain", "engine", "ers", "brakes", "wheels_tyres", "suspension_chassis", "aero_bodywork"}
SHARED = {"Engine": "engine_general", "Engine misfire": "engine_general", "Tyre puncture": "tyre", "Puncture": "tyre"}
LAPPED = r"^\+[0-9]+ Laps?$"


def rows() -> list[tuple[str, str, str, str]]:
    """(status, group, family, sub-family) of every listed status."""
    out = [("Finished", "finished", "finished", "finished")]
    for group, names in (("crash", CRASH), ("fuel", FUEL), ("admin", ADMIN), ("health", HEALTH)):
        out += [(n, group, group, group) for n in names]
    for family, names in MECHANICAL.items():
        for n in names:
            if family == "mechanical_other":
                sub = "other"
            elif family in OWN_NAME:
                sub = SHARED.get(n, n.lower().replace(" ", "_"))
            else:
                sub = family
            out.append((n, "mechanical", family, sub))
    return out


def classify(df: DataFrame, status: str) -> DataFrame:
    """Join group, family, sub-family and flags; lapped finishers follow a pattern.

    The list is a constant of this file, whose size the optimiser does not know: without the hint it
    shuffles all rows by their few statuses.
    """
    spark: SparkSession = df.sparkSession
    names = spark.createDataFrame(rows(), f"{status} string, _g string, _f string, _s string")
    d = df.join(F.broadcast(names), status, "left")
    lapped = F.col(status).rlike(LAPPED)
    pick = lambda c: F.coalesce(c, F.when(lapped, "lapped"), F.lit("other"))
    d = d.withColumns({"status_group": pick("_g"), "status_family": pick("_f"), "status_subfamily": pick("_s")}).drop("_g", "_f", "_s")
    return d.withColumns({
        "finished_flag": F.col("status_group").isin("finished", "lapped"),
        "dnf_flag": ~F.col("status_group").isin("finished", "lapped"),
    })
