"""Column functions for the radar's binary fields: bits, angles, dates and code labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and labels of the interface documents.
MESSAGE_TYPES = {
    1: "RDADigitalRadarData", 2: "RDAStatusData", 3: "RDAPerformanceMaintenanceData", 4: "RDAConsoleMessage", 5: "RDAVolumeCoveragePattern",
    6: "RDAControlCommands", 7: "RPGVolumeCoveragePattern", 8: "RPGClutterCensorZones", 9: "RPGRequestForData", 10: "RPGConsoleMessage",
    11: "RDALoopBackTest", 12: "RPGLoopBackTest", 13: "RDAClutterFilterBypassMap", 14: "Spare1", 15: "RDAClutterFilterMap", 16: "ReservedFAARMSOnly1",
    17: "ReservedFAARMSOnly2", 18: "RDAAdaptationData", 20: "Reserved1", 21: "Reserved2", 22: "Reserved3", 23: "Reserved4", 24: "ReservedFAARMSOnly3",
    25: "ReservedFAARMSOnly4", 26: "ReservedFAARMSOnly5", 29: "Reserved5", 31: "RDADigitalRadarDataGenericFormat", 32: "RDAPRFData", 33: "RDALogData",
}
CHANNELS = {
    0: "LegacySingleChannel", 1: "LegacyRedundantChannel1", 2: "LegacyRedundantChannel2",
    8: "ORDASingleChannel", 9: "ORDARedundantChannel1", 10: "ORDARedundantChannel2",
}
RADIAL_STATUS = {
    0: "ElevationStart", 1: "IntermediateRadialData", 2: "ElevationEnd", 3: "VolumeScanStart", 4: "VolumeScanEnd", 5: "ElevationStartVCPFinal",
}
COMPRESSION = {0: "Uncompressed", 1: "CompressedBZIP2", 2: "CompressedZLIB"}
CHANNEL_CONFIGURATION = {0: "ConstantPhase", 1: "RandomPhase", 2: "SZ2Phase"}
WAVEFORM = {1: "CS", 2: "CDW", 3: "CDWO", 4: "B", 5: "SPP"}
PULSE_WIDTH = {2: "Short", 4: "Long"}
RDA_STATUS = {2: "StartUp", 4: "Standby", 8: "Restart", 16: "Operate", 32: "Spare"}
OPERABILITY = {2: "OnLine", 4: "MaintenanceActionRequired", 8: "MaintenanceActionMandatory", 16: "CommandedShutDown", 32: "Inoperable"}
CONTROL_STATUS = {2: "LocalControlOnly", 4: "RemoteControlOnly", 8: "EitherLocalOrRemoteControl"}
GENERATOR_STATE = {
    1: "SwitchedToAuxiliaryPower", 2: "UtilityPowerAvailable", 4: "GeneratorOn", 8: "TransferSwitchSetToManual", 16: "CommandedSwitchover",
}
CONTROL_AUTHORIZATION = {0: "NoAction", 1: "LocalControlRequested", 2: "RemoteControlRequested"}
OPERATIONAL_MODE = {4: "Operational", 8: "Maintenance"}
SUPER_RESOLUTION = {2: "Enabled", 4: "Disabled"}
COMMAND_ACKNOWLEDGEMENT = {
    1: "RemoteVCPReceived", 2: "ClutterBypassMapReceived", 3: "ClutterCensorZonesReceived", 4: "RedundantChannelControlCommandAccepted",
}
SPOT_BLANKING = {0: "NotInstalled", 1: "Enabled", 4: "Disabled"}
TRANSITION_POWER = {0: "NotInstalled", 1: "Off", 3: "OK", 4: "Unknown"}
RMS_CONTROL = {0: "NonRMS", 2: "RMSInControl", 4: "RDAInControl"}
PERFORMANCE_CHECK = {0: "NoCommandPending", 1: "ForcePerformanceCheckPending", 2: "InProgress"}
SCAN_FLAGS = ("avset_enabled", "avset_disabled", "ebc_enabled", "log_data_enabled", "time_series_recording")
TRANSMISSION_FLAGS = ("none", "reflectivity", "velocity", "spectrum_width")
ALARM_SUMMARY_FLAGS = ("tower_utilities", "pedestal", "transmitter", "receiver", "rda_control", "communication", "signal_processor")
REQUEST_BITS = {
    "rda_status": 1, "performance_maintenance_data": 2, "clutter_filter_bypass_map": 4, "clutter_filter_map": 8, "adaptation_data": 16, "volume_coverage_pattern": 32,
}
VCP_DESCRIPTIONS = {
    12: "Precipitation, fast update", 31: "Clear air, long pulse", 32: "Clear air, short pulse", 35: "Clear air, SZ-2",
    112: "Precipitation, MPDA + SZ-2", 212: "Precipitation, SZ-2", 215: "General surveillance, SZ-2",
}

VARIABLE_LENGTH = 65535


def bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def flag(value: Column, bit: int) -> Column:
    return bits(value, bit, 1) == 1


def label(code: Column, names: dict, unknown: str = "Unknown({})") -> Column:
    """The code's name; otherwise unknown, with the code for {}; null stays null."""
    first, *rest = names.items()
    out = F.when(code == first[0], F.lit(first[1]))
    for k, v in rest:
        out = out.when(code == k, F.lit(v))
    before, _, after = unknown.partition("{}")
    other = F.concat(F.lit(before), code.cast("string"), F.lit(after)) if "{}" in unknown else F.lit(unknown)
    return F.when(code.isNotNull(), out.otherwise(other))


def label_sql(code: str, names: dict, unknown: str = "Unknown({})") -> str:
    """The same as a SQL CASE."""
    before, _, after = unknown.partition("{}")
    other = f"'{before}' || ({code})::varchar || '{after}'" if "{}" in unknown else f"'{unknown}'"
    return f"case {' '.join(f'when ({code}) = {k} then {v!r}' for k, v in names.items())} when ({code}) is null then null else {other} end"


def decode_angle(raw: Column) -> Column:
    """Bits 3 to 15, the highest worth 180 degrees."""
    return raw.bitwiseAND(F.lit(0xFFF8)) * F.lit(180.0) / F.lit(32768.0)


def decode_angular_velocity(raw: Column) -> Column:
    """Bits 3 to 14, the highest worth 22.5 degrees a second; bit 15 is the sign."""
    size = raw.bitwiseAND(F.lit(0x7FF8)) * F.lit(22.5) / F.lit(16384.0)
    return F.when(flag(raw, 15), -size).otherwise(size)


def mjd_millis(day: Column, millis: Column) -> Column:
    """Milliseconds since 1970 of a modified Julian day (1: 1970-01-01) and milliseconds past midnight."""
    return (day.cast("long") - 1) * F.lit(86_400_000).cast("long") + millis.cast("long")


def mjd_timestamp(day: Column, millis: Column) -> Column:
    return F.timestamp_millis(mjd_millis(day, millis))


def message_size_bytes(size: Column, count: Column, number: Column) -> Column:
    """Halfwords twice; at the variable-length mark, count and number hold 32 bits of bytes."""
    long = F.shiftleft(count.cast("long"), 16).bitwiseOR(number.cast("long"))
    return F.when(size < VARIABLE_LENGTH, size.cast("long") * 2).otherwise(long)


def is_segmented(size: Column, message_type: Column) -> Column:
    return (size < VARIABLE_LENGTH) & (message_type != 31)


def build_number(raw: Column) -> Column:
    """Hundredths if that is over 2, else tenths; builds 12 to 24 are whole."""
    value = F.when(raw / 100.0 > 2.0, raw / 100.0).otherwise(raw / 10.0)
    whole = F.floor(value + 0.5)
    return F.when(whole.between(12, 24), whole.cast("double")).otherwise(value)


def doppler_resolution(code: Column) -> Column:
    return F.when(code == 2, 0.5).when(code == 4, 1.0).otherwise(0.0)


def vcp_header(sequencing: Column, supplemental: Column) -> dict[str, Column]:
    """Fields of the pattern header's two bit words."""
    return {
        "n_elevations": bits(sequencing, 0, 0x1F), "max_sails_cuts": bits(sequencing, 5, 3), "sequence_active": flag(sequencing, 13), "truncated": flag(sequencing, 14),
        "sails": flag(supplemental, 0), "sails_cuts": bits(supplemental, 1, 7), "mrle": flag(supplemental, 4), "mrle_cuts": bits(supplemental, 5, 7),
        "mpda": flag(supplemental, 11), "base_tilt": flag(supplemental, 12), "base_tilts": bits(supplemental, 13, 7),
    }


def vcp_cut(super_resolution: Column, supplemental: Column) -> dict[str, Column]:
    """Fields of a cut's two bit words."""
    return {
        "half_degree_azimuth": flag(super_resolution, 0), "quarter_km_reflectivity": flag(super_resolution, 1), "doppler_to_300km": flag(super_resolution, 2),
        "dual_pol_to_300km": flag(super_resolution, 3), "sails_cut": flag(supplemental, 0), "sails_sequence": bits(supplemental, 1, 7), "mrle_cut": flag(supplemental, 4),
        "mrle_sequence": bits(supplemental, 5, 7), "mpda_cut": flag(supplemental, 9), "base_tilt_cut": flag(supplemental, 10),
    }


def clutter_mitigation(code: Column) -> Column:
    """Disabled, Enabled, or the bypass map's elevation segments (set bits 0 to 4)."""
    segments = F.array_compact(F.array(*[F.when(flag(code, k), F.lit(k)) for k in range(5)]))
    listed = F.array_join(F.transform(segments, lambda i: i.cast("string")), ",")
    return F.when(code == 0, "Disabled").when(code == 1, "Enabled").otherwise(F.concat(F.lit("BypassMapElevationSegments("), listed, F.lit(")")))


def real4(high: Column, low: Column) -> Column:
    """A 32-bit float from its two halfwords."""
    sign = F.when(flag(high, 15), -1.0).otherwise(1.0)
    exponent = bits(high, 7, 0xFF)
    fraction = (bits(high, 0, 0x7F) * 65536 + low) / 8388608.0
    tiny = sign * fraction * F.pow(F.lit(2.0), F.lit(-126.0))
    return F.when(exponent == 0, tiny).otherwise(sign * (fraction + 1.0) * F.pow(F.lit(2.0), exponent - 127))


def halfword_fields(halfwords: Column, layout) -> dict[str, Column]:
    """Fields of a message of halfwords (as performance data): layout lists (name, halfword from 1, kind), kinds u16, i16, u32 and f32."""
    out = {}
    for name, at, kind in layout:
        one, two = F.get(halfwords, F.lit(at - 1)), F.get(halfwords, F.lit(at))
        out[name] = {
            "u16": lambda a, b: a, "i16": lambda a, b: F.when(a >= 32768, a - 65536).otherwise(a), "u32": lambda a, b: a.cast("long") * 65536 + b, "f32": real4,
        }[kind](one, two)
    return out
