"""Parameters that a paper of a domain should state: hints for a model's prompt, and which of them a text mentions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.keywords import found_keywords

# Names of a domain, its title, its parameters with their units.
DOMAIN_PARAMETERS = {
    ("optics", "photonics"): ("Optics/Photonics", "wavelength (nm), laser_power (W/mW), pulse_duration (fs/ps/ns), repetition_rate (Hz/MHz), beam_diameter (mm/um), numerical_aperture (NA), focal_length (mm), magnification, cavity_finesse, cavity_Q_factor, fiber_type (SMF/MMF), coupling_efficiency (%), beam_quality_M2, polarization, modulation_frequency, detection_method, signal_to_noise_ratio (dB), dark_count_rate, BER (bit error rate), turbulence_strength (Cn2), propagation_distance (m/km), aperture_diameter, pixel_pitch, resolution, phase_mask_levels, diffraction_efficiency"),
    ("bio", "biology"): ("Biology/Biomedical", "cell_type, passage_number, seeding_density (cells/cm2), culture_medium, incubation_temperature (C), incubation_duration (h/days), CO2_concentration (%), assay_type, antibody_primary, antibody_secondary, staining_protocol, detection_method, sample_size_n, cell_viability (%), drug_concentration, exposure_time, imaging_modality, magnification, resolution"),
    ("ai_ml", "neural", "computer_science"): ("AI/ML", "architecture, num_layers, hidden_units, activation_function, optimizer, learning_rate, batch_size, epochs, training_time, regularization, dropout_rate, weight_initialization, training_data_size, test_data_split, loss_function, evaluation_metric, GPU_type, precision (fp16/fp32), augmentation_method, pretrained_model, fine_tuning_strategy"),
    ("materials", "crystal"): ("Materials Science", "substrate_type, substrate_temperature (C/K), deposition_rate (nm/s, A/s), chamber_pressure (Pa/Torr), film_thickness (nm/um), annealing_temperature (C/K), annealing_duration (min/h), annealing_atmosphere, precursor_materials, target_composition, sputtering_power (W), RF_frequency (MHz), grain_size (nm/um), crystal_structure, lattice_parameter (A/nm), surface_roughness (nm), hardness (GPa), Young_modulus (GPa), thermal_conductivity (W/mK), electrical_resistivity (ohm*cm), XRD_peaks (2theta), FWHM, crystallinity (%), porosity (%)"),
    ("energy", "volt"): ("Energy", "cell_efficiency (%), open_circuit_voltage (V), short_circuit_current (mA/cm2), fill_factor, bandgap (eV), absorber_thickness (nm/um), electrode_material, electrolyte_composition, charge_capacity (mAh/g), discharge_rate (C), cycle_number, capacity_retention (%), coulombic_efficiency (%), power_density (W/kg), energy_density (Wh/kg), internal_resistance (ohm), operating_temperature (C), illumination_intensity (mW/cm2, sun), active_area (cm2), HTL_material, ETL_material, perovskite_composition"),
    ("quantum", "qubit"): ("Quantum", "qubit_type, coherence_time_T1 (us/ms), coherence_time_T2 (us/ms), gate_fidelity (%), readout_fidelity (%), operating_temperature (mK/K), coupling_strength (MHz/GHz), resonator_frequency (GHz), anharmonicity (MHz), quantum_volume, error_rate, circuit_depth, number_of_qubits, connectivity, magnetic_field (T/mT), microwave_frequency (GHz), microwave_power (dBm), Rabi_frequency (MHz), detuning (MHz), photon_number, squeezing_parameter (dB)"),
}
HINT_HEAD = "DOMAIN-SPECIFIC PARAMETERS ({}) — extract ALL of these if mentioned:\n"
ANY_HINT = "Look for ALL quantitative parameters: temperatures, pressures, durations, concentrations,\nvoltages, currents, frequencies, distances, speeds, sizes, ratios, percentages, etc."


def domain_hint(domain: Column) -> Column:
    """The hint of a domain by any of its names; another domain, or none, gets the general one."""
    found = F.lit(ANY_HINT)
    for names, (title, parameters) in DOMAIN_PARAMETERS.items():
        found = F.when(domain.isin(list(names)), F.lit(HINT_HEAD.format(title) + parameters)).otherwise(found)
    return found


def parameter_words(parameters: str) -> dict[str, str]:
    """Words to look for, without unit and with blanks, and the parameter that each names."""
    names = [re.sub(r"\s*\(.*\)$", "", p) for p in re.split(r",\s+(?![^()]*\))", parameters)]
    return {n.replace("_", " ").lower(): n for n in names}


def mentioned_parameters(docs: DataFrame, text: str = "text", domain: str = "domain") -> DataFrame:
    """``docs`` with ``parameters``: those of the domain that the text names, in the domain's order; one pass over a text for all domains."""
    words = list(dict.fromkeys(w for _, p in DOMAIN_PARAMETERS.values() for w in parameter_words(p)))
    named = F.array().cast("array<string>")
    for names, (_, parameters) in DOMAIN_PARAMETERS.items():
        own = F.array(*(F.struct(F.lit(words.index(w)).alias("at"), F.lit(n).alias("name")) for w, n in parameter_words(parameters).items()))
        listed = F.transform(F.filter(own, lambda x: F.array_contains("_found", x["at"])), lambda x: x["name"])
        named = F.when(F.col(domain).isin(list(names)), listed).otherwise(named)
    return docs.withColumn("_found", found_keywords(words)(F.col(text))).withColumn("parameters", named).drop("_found")
