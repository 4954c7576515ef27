"""Physical and numeric constants. CODATA and particle data tables; energies in MeV, lengths in fm where the name says so."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

CONSTANTS: dict[str, float] = {
    "hbar_SI": 1.054571817e-34, "electron_mass_SI": 9.1093837015e-31, "elementary_charge_SI": 1.602176634e-19, "epsilon_0_SI": 8.8541878128e-12, "k_coulomb_SI": 8.9875517923e9, "speed_of_light_SI": 299792458.0,
    "proton_mass_SI": 1.67262192369e-27, "neutron_mass_SI": 1.67492749804e-27, "bohr_radius": 5.29177210903e-11, "hartree_to_eV": 27.211386245988, "hydrogen_ground_state_hartree": -0.5,
    "fine_structure_constant": 1 / 137.035999084, "classical_electron_radius_SI": 2.8179403262e-15, "compton_wavelength_SI": 2.42631023867e-12, "hbar_c_MeV_fm": 197.3269804,
    "electron_mass_MeV": 0.51099895, "proton_mass_MeV": 938.27208816, "neutron_mass_MeV": 939.56542052, "pion_0_mass_MeV": 134.9768, "pion_charged_mass_MeV": 139.57039, "proton_g_factor": 5.585694702,
    "deuteron_binding_energy_MeV": -2.224575, "tritium_binding_energy_MeV": -8.4820, "helium3_binding_energy_MeV": -7.7181, "helium4_binding_energy_MeV": -28.2957, "neutron_lifetime_s": 879.4, "fermi_coupling_constant_MeV2": 1.1663787e-11,
    "semf_a_volume_MeV": 15.75, "semf_a_surface_MeV": 17.80, "semf_a_coulomb_MeV": 0.711, "semf_a_asymmetry_MeV": 23.70, "semf_a_pairing_MeV": 11.18,
    "qed_two_loop_coefficient": -0.328478965579193, "qed_three_loop_coefficient": 1.181241456587, "qed_four_loop_coefficient": -1.9144,
}
#: Values that follow from others, in atomic units where the name says au.
CONSTANTS |= {
    "hydrogen_ground_state_eV": CONSTANTS["hydrogen_ground_state_hartree"] * CONSTANTS["hartree_to_eV"], "classical_electron_radius_au": CONSTANTS["fine_structure_constant"] ** 2,
    "compton_wavelength_au": 2 * math.pi * CONSTANTS["fine_structure_constant"], "MeV_to_hartree": 1e6 / CONSTANTS["hartree_to_eV"], "fm_to_bohr": 1e-15 / CONSTANTS["bohr_radius"],
    "nucleon_reduced_mass_MeV": CONSTANTS["proton_mass_MeV"] * CONSTANTS["neutron_mass_MeV"] / (CONSTANTS["proton_mass_MeV"] + CONSTANTS["neutron_mass_MeV"]),
}


def table(spark: SparkSession) -> DataFrame:
    """name and value of every constant."""
    return spark.createDataFrame(list(CONSTANTS.items()), "name string, value double")
