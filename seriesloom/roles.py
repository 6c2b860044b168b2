"""Column roles: which column is text, number tokens, numeric, dropped or defaulted."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values. These names, tags and constants are data: trained models and
# input tables depend on them, so they must be spelled exactly like this.
# ---------------------------------------------------------------------------

TEXT_COLUMNS = (
    "image_type",
    "sequence_variant",
    "diffusion_bvalue",
    "diffusion_bvalue_ge",
    "diffusion_bvalue_siemens",
    "diffusion_bvalue_final",
    "in_plane_phase_encoding_direction",
    "mr_acquisition_type",
    "patient_position",
    "manufacturer",
    "manufacturer_model_name",
    "receive_coil_name",
    "transmit_coil_name",
    "scanning_sequence",
    "software_versions",
    "scan_options",
    "photometric_interpretation",
    "modality",
    "series_description",
)

NUMBER_TOKEN_COLUMNS = (
    "acquisition_matrix",
    "echo_time",
    "echo_train_length",
    "repetition_time",
    "flip_angle",
    "reconstruction_matrix",
    "magnetic_field_strength",
    "number_of_phase_encoding_steps",
    "percent_phase_field_of_view",
    "pixel_bandwidth",
    "sar",
    "slice_thickness",
    "temporal_resolution",
    "image_orientation_patient",
    "inversion_time",
    "pixel_spacing",
    "number_of_echos",
    "number_of_temporal_positions",
)

NUMERIC_COLUMNS = (
    "number_of_images",
    "image_mean",
    "image_std",
    "image_min",
    "image_max",
    "image_median",
    "image_skew",
    "image_kurtosis",
    "image_entropy",
    "image_rms",
    "image_blur_effect",
    *(f"image_moment_{i}" for i in range(7)),
    # "intertia" is the spelling the training tables use, see README
    "image_intertia_tensor_eigval_0",
    "image_intertia_tensor_eigval_1",
)

IMAGE_COLUMNS = (
    "image_mean",
    "image_std",
    "image_min",
    "image_max",
    "image_median",
    "image_skew",
    "image_kurtosis",
    "image_entropy",
    "image_rms",
    "image_blur_effect",
    "image_x",
    "image_y",
    *(f"image_moment_{i}" for i in range(7)),
    *(f"image_inertia_tensor_eigval_{i}" for i in range(4)),
)

DROPPED_COLUMNS = (
    "study_uid",
    "series_uid",
    "class",
    "diffusion_directionality",
    "spectrally_selected_suppression",
    "reconstruction_matrix",
    "number_of_phase_encoding_steps",
    "inversion_time",
    "image_x",
    "image_y",
    "seg",
    "valid",
)

DEFAULT_VALUES = {
    "diffusion_bvalue": "-",
    "diffusion_bvalue_ge": "-",
    "diffusion_bvalue_siemens": "-",
    "diffusion_bvalue_final": "-",
    "number_of_echos": "1",
    "number_of_temporal_positions": "1",
    "temporal_resolution": "0",
}

# DICOM "group,element" of every header column.
HEADER_TAGS = {
    "study_uid": "0020,000D",
    "series_uid": "0020,000E",
    "diffusion_bvalue": "0018,9087",
    "diffusion_directionality": "0018,9075",
    "echo_time": "0018,0081",
    "echo_train_length": "0018,0091",
    "repetition_time": "0018,0080",
    "flip_angle": "0018,1314",
    "in_plane_phase_encoding_direction": "0018,1312",
    "mr_acquisition_type": "0018,0023",
    "acquisition_matrix": "0018,1310",
    "patient_position": "0018,5100",
    "reconstruction_matrix": "0018,1100",
    "magnetic_field_strength": "0018,0087",
    "manufacturer": "0008,0070",
    "manufacturer_model_name": "0008,1090",
    "body_part_examined": "0018,0015",
    "number_of_phase_encoding_steps": "0018,0089",
    "percent_phase_field_of_view": "0018,0094",
    "pixel_bandwidth": "0018,0095",
    "receive_coil_name": "0018,1250",
    "transmit_coil_name": "0018,1251",
    "sar": "0018,1316",
    "scanning_sequence": "0018,0020",
    "sequence_variant": "0018,0021",
    "slice_thickness": "0018,0050",
    "software_versions": "0018,1020",
    "temporal_resolution": "0020,0110",
    "image_orientation_patient": "0020,0037",
    "image_type": "0008,0008",
    "scan_options": "0018,0022",
    "photometric_interpretation": "0028,0004",
    "spectrally_selected_suppression": "0018,9025",
    "inversion_time": "0018,0082",
    "pixel_spacing": "0028,0030",
    "number_of_echos": "0018,0086",
    "number_of_temporal_positions": "0020,0105",
    "modality": "0008,0060",
    "series_description": "0008,103E",
    "diffusion_bvalue_ge": "0043,1039",
    "diffusion_bvalue_siemens": "0019,100C",
}

# SOP class of segmentation objects.
SEGMENTATION_SOP_CLASS = "1.2.840.10008.5.1.4.1.1.66.4"

# Placeholder of a tag that is absent.
MISSING = "-"

SERIES_KEYS = ("study_uid", "series_uid", "patient_id")
STUDY_KEYS = ("study_uid", "patient_id")

# ---------------------------------------------------------------------------


def tag_key_names() -> dict[str, str]:
    """Rename preset for tables whose columns are lower-case tag keys (``"0018,0081"``)."""
    private_or_unlisted = {"body_part_examined", "diffusion_bvalue_ge", "diffusion_bvalue_siemens"}
    names = {tag.lower(): name for name, tag in HEADER_TAGS.items() if name not in private_or_unlisted}
    return {"0010,0020": "patient_id", "0020,0013": "instance_number", **names}


@dataclass(frozen=True)
class Roles:
    """Role of every column an operator may touch; absent columns are skipped."""

    text: tuple[str, ...] = TEXT_COLUMNS
    number_token: tuple[str, ...] = NUMBER_TOKEN_COLUMNS
    numeric: tuple[str, ...] = NUMERIC_COLUMNS
    image: tuple[str, ...] = IMAGE_COLUMNS
    drop: tuple[str, ...] = DROPPED_COLUMNS
    defaults: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_VALUES))
    keys: tuple[str, ...] = SERIES_KEYS

    def restricted(
        self, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None
    ) -> Roles:
        """Same roles limited to ``include`` and without ``exclude``."""
        banned = set(exclude or ())
        wanted = None if include is None else set(include)

        def keep(names: tuple[str, ...]) -> tuple[str, ...]:
            return tuple(n for n in names if n not in banned and (wanted is None or n in wanted))

        return replace(
            self, text=keep(self.text), number_token=keep(self.number_token), numeric=keep(self.numeric)
        )

    def present(self, columns: Iterable[str]) -> Roles:
        """Feature roles limited to the columns a table has."""
        return self.restricted(include=columns)


STANDARD = Roles()
