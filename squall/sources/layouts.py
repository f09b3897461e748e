"""Wire layouts as tables: field names and big-endian struct codes.

A layout is parsed by one generic reader; messages that differ by build are told
apart by the length they carry.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

# Fixed values: (field, struct code) in wire order; "_" names padding.
VOLUME_HEADER = (("tape_filename", "9s"), ("extension", "3s"), ("mjd", "I"), ("ms", "I"), ("icao", "4s"))
MESSAGE_HEADER = (
    ("_", "12s"), ("segment_size", "H"), ("channel", "B"), ("message_type", "B"), ("sequence", "H"), ("mjd", "H"), ("ms", "I"),
    ("segment_count", "H"), ("segment_number", "H"),
)
RADIAL_HEADER = (
    ("radar_identifier", "4s"), ("ms", "I"), ("mjd", "H"), ("azimuth_number", "H"), ("azimuth_angle", "f"), ("compression_indicator", "B"), ("_", "B"),
    ("radial_length", "H"), ("azimuth_resolution_spacing", "B"), ("radial_status", "B"), ("elevation_number", "B"), ("cut_sector_number", "B"),
    ("elevation_angle", "f"), ("spot_blanking", "B"), ("azimuth_indexing_mode", "B"), ("data_block_count", "H"),
)
VOLUME_BLOCK = (
    ("lrtup", "H"), ("major_version", "B"), ("minor_version", "B"), ("latitude", "f"), ("longitude", "f"), ("site_height", "h"), ("tower_height", "H"),
    ("calibration_constant", "f"), ("horizontal_tx_power", "f"), ("vertical_tx_power", "f"), ("system_zdr", "f"), ("initial_phi", "f"), ("vcp", "H"), ("processing_status", "H"),
)
VOLUME_BLOCK_MORE = (("zdr_bias", "H"), ("_", "6s"))
ELEVATION_BLOCK = (("lrtup", "H"), ("atmos", "h"), ("calibration_constant", "f"))
RADIAL_BLOCK = (("lrtup", "H"), ("unambiguous_range", "H"), ("horizontal_noise", "f"), ("vertical_noise", "f"), ("nyquist_velocity", "H"), ("radial_flags", "H"))
RADIAL_BLOCK_MORE = (("horizontal_calibration", "f"), ("vertical_calibration", "f"))
MOMENT_BLOCK = (
    ("_", "I"), ("gate_count", "H"), ("first_gate_m", "H"), ("gate_interval_m", "H"), ("tover", "H"), ("snr_threshold", "h"), ("control_flags", "B"), ("word_size", "B"),
    ("scale", "f"), ("offset", "f"),
)
PATTERN_HEADER = (
    ("message_size", "H"), ("pattern_type", "H"), ("pattern_number", "H"), ("n_cuts", "H"), ("version", "B"), ("clutter_map_group", "B"), ("doppler_resolution", "B"),
    ("pulse_width", "B"), ("_", "I"), ("sequencing", "H"), ("supplemental", "H"), ("_", "H"),
)
PATTERN_CUT = (
    ("elevation_angle", "H"), ("channel_configuration", "B"), ("waveform_type", "B"), ("super_resolution", "B"), ("surveillance_prf", "B"), ("surveillance_pulses", "H"),
    ("azimuth_rate", "H"), ("ref_threshold", "h"), ("vel_threshold", "h"), ("sw_threshold", "h"), ("zdr_threshold", "h"), ("phi_threshold", "h"), ("rho_threshold", "h"),
    ("sector_1_edge", "H"), ("sector_1_prf", "H"), ("sector_1_pulses", "H"), ("supplemental", "H"), ("sector_2_edge", "H"), ("sector_2_prf", "H"), ("sector_2_pulses", "H"),
    ("ebc_angle", "H"), ("sector_3_edge", "H"), ("sector_3_prf", "H"), ("sector_3_pulses", "H"), ("_", "H"),
)
LEGACY_RADIAL = (
    ("ms", "I"), ("mjd", "H"), ("unambiguous_range", "H"), ("azimuth_angle", "H"), ("azimuth_number", "H"), ("radial_status", "H"), ("elevation_angle", "H"),
    ("elevation_number", "H"), ("surveillance_first", "h"), ("doppler_first", "h"), ("surveillance_interval", "H"), ("doppler_interval", "H"), ("surveillance_gates", "H"),
    ("doppler_gates", "H"), ("sector_number", "H"), ("calibration_constant", "f"), ("ref_pointer", "H"), ("vel_pointer", "H"), ("sw_pointer", "H"),
    ("doppler_resolution", "H"), ("vcp", "H"), ("_", "54s"),
)
STATUS = (
    ("rda_status", "H"), ("operability_status", "H"), ("control_status", "H"), ("generator_state", "H"), ("average_transmitter_power", "H"), ("horizontal_calibration", "H"),
    ("data_transmission_enabled", "H"), ("vcp", "h"), ("control_authorization", "H"), ("build_number", "H"), ("operational_mode", "H"), ("super_resolution_status", "H"),
    ("clutter_mitigation", "H"), ("scan_data_flags", "H"), ("alarm_summary", "H"), ("command_acknowledgement", "H"), ("channel_control_status", "H"),
    ("spot_blanking_status", "H"), ("bypass_map_date", "H"), ("bypass_map_minutes", "H"), ("clutter_map_date", "H"), ("clutter_map_minutes", "H"),
    ("vertical_calibration", "H"), ("transition_power_source", "H"), ("rms_control_status", "H"), ("performance_check_status", "H"),
    *((f"alarm_{k}", "H") for k in range(1, 15)), ("signal_processor_options", "H"), ("_", "34s"), ("downloaded_pattern_number", "H"), ("status_version", "H"),
)
CONTROL_COMMANDS = (
    ("state_command", "H"), ("log_command", "H"), ("generator_control", "H"), ("control_authorization", "H"), ("restart_vcp_or_cut", "H"), ("local_vcp", "H"), ("_", "2s"),
    ("super_resolution_control", "H"), ("clutter_mitigation_control", "H"), ("avset_control", "H"), ("_", "2s"), ("channel_control", "H"), ("performance_check_control", "H"),
    ("zdr_bias_estimate", "h"), ("_", "12s"), ("spot_blanking", "H"), ("_", "10s"),
)
CENSOR_REGION = (("start_range", "H"), ("stop_range", "H"), ("start_azimuth", "H"), ("stop_azimuth", "H"), ("elevation_segment", "H"), ("select_code", "H"))
MAP_HEADER = (("map_date", "H"), ("map_minutes", "H"), ("n_segments", "H"))
LOG_HEADER = (("version", "I"), ("identifier", "26s"), ("data_version", "I"), ("compression", "I"), ("compressed_size", "I"), ("decompressed_size", "I"), ("_", "22s"))
ADAPTATION_HEADER = (("file_name", "12s"), ("format", "4s"), ("revision", "4s"), ("date", "12s"), ("time", "12s"))
#: Adaptation fields by byte offset in the document: (field, kind, offset).
# Fixed values: (field, struct code, byte offset) of the adaptation document, in the order of offsets.
ADAPTATION_FIELDS = (
    ("lower_pre_limit", "f", 44), ("az_lat", "f", 48), ("upper_pre_limit", "f", 52), ("el_lat", "f", 56), ("parkaz", "f", 60), ("parkel", "f", 64),
    ("a_min_shelter_temp", "f", 112), ("a_max_shelter_temp", "f", 116), ("a_min_shelter_ac_temp_diff", "f", 120), ("a_max_xmtr_air_temp", "f", 124),
    ("a_max_rad_temp", "f", 128), ("a_max_rad_temp_rise", "f", 132), ("lower_dead_limit", "f", 136), ("upper_dead_limit", "f", 140),
    ("a_min_gen_room_temp", "f", 148), ("a_max_gen_room_temp", "f", 152), ("spip_5v_reg_lim", "f", 156), ("spip_15v_reg_lim", "f", 160),
    ("rpg_co_located", "4s", 176), ("spec_filter_installed", "4s", 180), ("tps_installed", "4s", 184), ("rms_installed", "4s", 188), ("a_hvdl_tst_int", "I", 192),
    ("a_rpg_lt_int", "I", 196), ("a_min_stab_util_pwr_time", "I", 200), ("a_gen_auto_exer_interval", "I", 204), ("a_util_pwr_sw_req_interval", "I", 208),
    ("a_low_fuel_level", "f", 212), ("config_chan_number", "I", 216), ("redundant_chan_config", "I", 224), ("path_loss_vertical_if_heliax", "f", 668),
    ("path_loss_2a9a9", "f", 692), ("path_loss_horizontal_if_heliax", "f", 752), ("h_coupler_xmt_loss", "f", 756), ("path_loss_wg02", "f", 768),
    ("path_loss_waveguide_klystron", "f", 772), ("path_loss_wg06", "f", 780), ("path_loss_wg04", "f", 796), ("path_loss_a6", "f", 800),
    ("h_coupler_cw_loss", "f", 832), ("v_coupler_xmt_loss", "f", 836), ("v_coupler_cw_loss", "f", 852), ("pwr_sense_bias", "f", 864), ("ame_v_noise_enr", "f", 868),
    ("v_ts_cw", "f", 936), ("tfreq_mhz", "I", 1092), ("base_data_tcn", "f", 1096), ("refl_data_tover", "f", 1100), ("tar_h_dbz0_lp", "f", 1104),
    ("tar_v_dbz0_lp", "f", 1108), ("init_phi_dp", "I", 1112), ("norm_init_phi_dp", "I", 1116), ("lx_lp", "f", 1120), ("lx_sp", "f", 1124),
    ("meteor_param", "f", 1128), ("antenna_gain", "f", 1136), ("vel_degrad_limit", "f", 1152), ("wth_degrad_limit", "f", 1156),
    ("h_noisetemp_dgrad_limit", "f", 1160), ("h_min_noisetemp", "I", 1164), ("v_noisetemp_dgrad_limit", "f", 1168), ("v_min_noisetemp", "I", 1172),
    ("kly_degrade_limit", "f", 1176), ("ts_coho", "f", 1180), ("h_ts_cw", "f", 1184), ("ts_stalo", "f", 1196), ("ame_h_noise_enr", "f", 1200),
    ("xmtr_peak_pwr_high_limit", "f", 1204), ("xmtr_peak_pwr_low_limit", "f", 1208), ("h_dbz0_delta_limit", "f", 1212), ("threshold1", "f", 1216),
    ("threshold2", "f", 1220), ("clut_supp_dgrad_lim", "f", 1224), ("range0_value", "f", 1232), ("xmtr_pwr_mtr_scale", "f", 1236), ("v_dbz0_delta_limit", "f", 1240),
    ("tar_h_dbz0_sp", "f", 1244), ("tar_v_dbz0_sp", "f", 1248), ("deltaprf", "I", 1252), ("tau_sp", "I", 1264), ("tau_lp", "I", 1268), ("nc_dead_value", "I", 1272),
    ("tau_rf_sp", "I", 1276), ("tau_rf_lp", "I", 1280), ("seg1lim", "f", 1284), ("slatsec", "f", 1288), ("slonsec", "f", 1292), ("slatdeg", "I", 1300),
    ("slatmin", "I", 1304), ("slondeg", "I", 1308), ("slonmin", "I", 1312), ("slatdir", "4s", 1316), ("slondir", "4s", 1320), ("dig_rcvr_clock_freq", "d", 2500),
    ("coho_freq", "d", 2508), ("az_correction_factor", "f", 8360), ("el_correction_factor", "f", 8364), ("site_name", "4s", 8368),
    ("ant_manual_setup_iel_min", "i", 8372), ("ant_manual_setup_iel_max", "I", 8376), ("ant_manual_setup_fazvelmax", "I", 8380),
    ("ant_manual_setup_felvelmax", "I", 8384), ("site_ground_height", "I", 8388), ("site_radar_height", "I", 8392), ("az_pos_sustain_drive", "f", 8396),
    ("az_neg_sustain_drive", "f", 8400), ("az_inertia", "f", 8456), ("el_inertia", "f", 8460), ("az_stow_angle", "f", 8496), ("el_stow_angle", "f", 8500),
    ("doppler_range_start", "f", 8764), ("max_el_index", "I", 8768), ("seg2lim", "f", 8772), ("seg3lim", "f", 8776), ("seg4lim", "f", 8780),
    ("nbr_el_segments", "I", 8784), ("h_noise_long", "f", 8788), ("ant_noise_temp", "f", 8792), ("h_noise_short", "f", 8796), ("h_noise_tolerance", "f", 8800),
    ("min_h_dyn_range", "f", 8804), ("v_noise_tolerance", "f", 8816), ("min_v_dyn_range", "f", 8820), ("zdr_offset_dgrad_lim", "f", 8824),
    ("baseline_zdr_offset", "f", 8828), ("v_noise_long", "f", 8844), ("v_noise_short", "f", 8848), ("zdr_data_tover", "f", 8852), ("phi_data_tover", "f", 8856),
    ("rho_data_tover", "f", 8860), ("stalo_power_dgrad_limit", "f", 8864), ("stalo_power_maint_limit", "f", 8868), ("min_h_pwr_sense", "f", 8872),
    ("min_v_pwr_sense", "f", 8876), ("h_pwr_sense_offset", "f", 8880), ("v_pwr_sense_offset", "f", 8884), ("ps_gain_ref", "f", 8888),
    ("rf_pallet_broad_loss", "f", 8892), ("ame_ps_tolerance", "f", 8960), ("ame_max_temp", "f", 8964), ("ame_min_temp", "f", 8968), ("rcvr_mod_max_temp", "f", 8972),
    ("rcvr_mod_min_temp", "f", 8976), ("bite_mod_max_temp", "f", 8980), ("bite_mod_min_temp", "f", 8984), ("default_polarization", "I", 8988),
    ("tr_limit_dgrad_limit", "f", 8992), ("tr_limit_fail_limit", "f", 8996), ("rfp_stepper_enabled", "4s", 9000), ("ame_current_tolerance", "f", 9008),
    ("h_only_polarization", "I", 9012), ("v_only_polarization", "I", 9016), ("sun_bias", "f", 9028), ("a_min_shelter_temp_warn", "f", 9032),
    ("power_meter_zero", "f", 9036), ("txb_baseline", "f", 9040), ("txb_alarm_thresh", "f", 9044),
)
#: Adaptation fields of several values: (field, kind, offsets).
# Fixed values: (field, struct code, byte offsets) of its lists.
ADAPTATION_LISTS = (
    ("a_fuel_conv", "f", tuple(range(68, 112, 4))), ("atten_table", "f", tuple(range(228, 644, 4))), ("h_rnscale", "f", tuple(range(940, 992, 4))),
    ("atmos", "f", tuple(range(992, 1044, 4))), ("el_index", "f", tuple(range(1044, 1092, 4))), ("v_rnscale", "f", (*range(8700, 8744, 4), 8752, 8756)),
)
ADAPTATION_BYTES = 9468

FRAME_BYTES = 2432
HEADER_BYTES = 28
BYPASS_RADIALS, BYPASS_WORDS = 360, 32
MAP_AZIMUTHS = 360
MOMENTS = {b"REF": "REF", b"VEL": "VEL", b"SW ": "SW", b"ZDR": "ZDR", b"PHI": "PHI", b"RHO": "RHO", b"CFP": "CFP"}


@functools.cache
def compiled(layout) -> tuple[struct.Struct, tuple[str, ...]]:
    return struct.Struct(">" + "".join(code for _, code in layout)), tuple(name for name, _ in layout)


def size(layout) -> int:
    return compiled(layout)[0].size


def read(layout, data: bytes, at: int = 0) -> dict:
    """Named values at a byte offset; struct.error if the bytes run out."""
    codes, names = compiled(layout)
    out = dict(zip(names, codes.unpack_from(data, at), strict=True))
    out.pop("_", None)
    return out


@functools.cache
def _absent(layout) -> tuple:
    """(name, its value where it is absent) of each field."""
    return tuple((name, b"" if code.endswith("s") else 0) for name, code in layout)


def write(layout, values: dict) -> bytes:
    """The inverse: absent fields are zero."""
    given = [values.get(name, absent) for name, absent in _absent(layout)]
    return compiled(layout)[0].pack(*[v.encode() if isinstance(v, str) else v for v in given])


@functools.cache
def dtype(layout) -> np.dtype:
    """A layout as numpy's type of one row; padding has the names _0, _1, ..."""
    kinds = {"H": ">u2", "h": ">i2", "I": ">u4", "i": ">i4", "B": "u1", "f": ">f4", "d": ">f8"}
    return np.dtype([(f"_{k}" if name == "_" else name, f"S{code[:-1]}" if code.endswith("s") else kinds[code]) for k, (name, code) in enumerate(layout)])


def bytes_at(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n bytes from each offset, a row each; offsets at equal distances give a view."""
    step = int(at[1] - at[0]) if len(at) > 1 else n
    if len(at) and step > 0 and np.all(np.diff(at) == step):
        return np.lib.stride_tricks.as_strided(data[at[0] :], (len(at), n), (step, 1), writeable=False)
    return data[at[:, None] + np.arange(n)]


def read_many(layout, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``read`` at many offsets of an array of bytes, as a structured array; all of them lie within."""
    kind = dtype(layout)
    return np.ascontiguousarray(bytes_at(data, at, kind.itemsize)).view(kind)[:, 0] if len(at) else np.zeros(0, kind)


def write_many(layout, n: int, values: dict) -> np.ndarray:
    """``write`` of n rows, from single values or arrays, as n rows of bytes; absent fields are zero."""
    out = np.zeros(n, dtype(layout))
    for name in out.dtype.names:
        if name in values:
            out[name] = values[name]
    return out.view(np.uint8).reshape(n, -1)


def text(raw: bytes) -> str | None:
    """UTF-8 text without trailing NULs and blanks; None if it is none."""
    try:
        return raw.decode("utf-8").rstrip("\0").strip()
    except UnicodeDecodeError:
        return None


def sexagesimal(degrees, minutes, seconds, direction: str | None, negative: str):
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return -value if (direction or "").startswith(negative) else value
