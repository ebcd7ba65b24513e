"""Names, tables and patterns that decide results."""

# --- fixed values: file extension -> file format --------------------------
FORMAT_OF_EXT = {
    ".blp": "BLP",
    ".bmp": "BMP",
    ".dds": "DDS",
    ".jpg": "JPEG",
    ".jpeg": "JPEG",
    ".png": "PNG",
    ".tex": "TEX",
    ".tga": "TGA",
}

# --- fixed values: output format index -> name and extension --------------
OUTPUT_FORMATS = ["BLP", "BMP", "DDS", "JPEG", "PNG", "TGA"]
OUTPUT_EXTENSIONS = [".blp", ".bmp", ".dds", ".jpg", ".png", ".tga"]

# --- fixed values: output extension when none is asked for ----------------
DEFAULT_OUTPUT_EXT = {
    "BLP": ".dds",
    "BMP": ".dds",
    "DDS": ".blp",
    "JPEG": ".png",
    "PNG": ".jpg",
    "TEX": ".dds",
    "TGA": ".dds",
}

# --- fixed values: name part -> kind, first hit wins ----------------------
KIND_RULES = [
    ("_diff", "Diffuse"),
    ("diffuse", "Diffuse"),
    ("_orm", "Multikind"),
    ("_tint", "Multikind"),
    ("_ao", "AmbientOcclusion"),
    ("occlusion", "AmbientOcclusion"),
    ("_roughness", "Roughness"),
    ("_rough", "Roughness"),
    ("_metal", "Metalness"),
    ("_gloss", "Gloss"),
    ("_smooth", "Gloss"),
    ("_spec", "Specular"),
    ("specular", "Specular"),
    ("_emis", "Emissive"),
    ("emissive", "Emissive"),
    ("_alpha", "AlphaMask"),
    ("_mask", "AlphaMask"),
    ("_opacity", "AlphaMask"),
    ("lightmap", "Lightmap"),
    ("_envpbr", "EnvironmentPBR"),
    ("_ibl", "EnvironmentPBR"),
    ("_envlegacy", "EnvironmentLegacy"),
    ("_envmap", "EnvironmentLegacy"),
    ("_env", "EnvironmentLegacy"),
    ("_reflection", "EnvironmentLegacy"),
    ("_albedo", "Albedo"),
    ("_basecolor", "Albedo"),
    ("normal", "Normal"),
    ("_nrm", "Normal"),
    ("_norm", "Normal"),
]

# --- fixed values: pixel format -> kind when no name part hits ------------
KIND_OF_FORMAT = {
    "Normal": ["BC5", "RG8", "RG16", "RG32F"],
    "Roughness": ["BC4", "R8", "R16", "R32F"],
}
FALLBACK_KIND = "Diffuse"

# --- fixed values: kinds of the R, G, B, A channels -----------------------
CHANNEL_KIND_RULES = [
    ("_orm", ["AmbientOcclusion", "Roughness", "Metalness", "Unused"]),
    ("_tint", ["AlphaMask", "AlphaMask", "AlphaMask", "Unused"]),
]
FALLBACK_CHANNEL_KINDS = ["Other", "Other", "Other", "Other"]

# --- fixed values: kind names accepted on a conversion request ------------
KIND_OF_ARGUMENT = {
    "diffuse": "Diffuse",
    "normal": "Normal",
    "specular": "Specular",
    "orm": "ORM",
    "albedo": "Albedo",
    "roughness": "Roughness",
    "metalness": "Metalness",
    "ao": "AmbientOcclusion",
    "gloss": "Gloss",
    "emissive": "Emissive",
    "alpha_mask": "AlphaMask",
    "binary_mask": "BinaryMask",
    "transparency_mask": "TransparencyMask",
    "blend_mask": "BlendMask",
    "lightmap": "Lightmap",
    "env_pbr": "EnvironmentPBR",
    "env_legacy": "EnvironmentLegacy",
    "multikind": "Multikind",
    "other": "Other",
}

# --- fixed values: kinds stored in one channel ----------------------------
CHANNEL_MAP_KINDS = ["Roughness", "Metalness", "AmbientOcclusion", "Gloss"]

# --- fixed values: pixel format -> bytes per pixel / per 4x4 block --------
BYTES_PER_PIXEL = {
    "R8": 1,
    "R16": 2,
    "R32F": 4,
    "RG8": 2,
    "RG16": 4,
    "RG32F": 8,
    "RGBA8": 4,
    "RGBA16": 8,
    "RGBA32F": 16,
}
BYTES_PER_BLOCK = {
    "BC1": 8,
    "BC2": 16,
    "BC3": 16,
    "BC4": 8,
    "BC5": 16,
    "BC6H": 16,
    "BC7": 16,
}
PIXEL_FORMATS = [*BYTES_PER_PIXEL, *BYTES_PER_BLOCK]
SINGLE_CHANNEL_FORMATS = ["R8", "R16", "R32F", "BC4"]

# --- fixed values: format in which a block-compressed texture is edited ---
WORKING_FORMATS = {"BC4": "R32F", "BC5": "RG32F"}
WORKING_FORMAT_OTHER = "RGBA32F"

# --- fixed values: BLP options --------------------------------------------
BLP_ALLOWED_V1 = [2, 3]
BLP_ALLOWED_V2 = [0, 1, 2, 3, 4, 5, 6]
BLP_ENCODING_CODES = {0: "Infer", 1: "BGRA", 2: "Palettized", 3: "JPEG", 4: "DXT", 5: "DXT", 6: "DXT"}
BLP_TARGETS = {0: "RGBA8", 1: "RGBA8", 2: "RGBA8", 3: "RGBA8", 4: "BC1", 5: "BC2", 6: "BC3"}
BLP_COMPRESSION_ARGUMENTS = {"true_color": 1, "paletted": 2, "jpeg": 3, "bc1": 4, "bc2": 5, "bc3": 6}

# --- fixed values: DDS options; index 8 is BC3 with swapped channels ------
DDS_ALLOWED_NORMAL = [0, 5, 8]
DDS_ALLOWED_CHANNEL = [0, 4]
DDS_ALLOWED_OTHER = [0, 1, 2, 3, 6, 7]
DDS_TARGETS = {0: "RGBA8", 1: "BC1", 2: "BC2", 3: "BC3", 4: "BC4", 5: "BC5", 6: "BC6H", 7: "BC7", 8: "BC3"}
DDS_BC3N = 8
DDS_FORMAT_ARGUMENTS = {
    "true_color": 0,
    "bc1": 1,
    "bc2": 2,
    "bc3": 3,
    "bc4": 4,
    "bc5": 5,
    "bc6": 6,
    "bc7": 7,
    "bc3n": 8,
}

# --- fixed values: downscale factors on a conversion request --------------
DOWNSCALE_ARGUMENTS = {"x2": 1, "x4": 2}

# --- fixed values: display names ------------------------------------------
DISPLAY_NAMES = {
    "file_format": {f: f for f in ["BLP", "BMP", "DDS", "JPEG", "PNG", "TEX", "TGA"]},
    "pixel_format": {
        "R8": "R8",
        "R16": "R16",
        "R32F": "R32F",
        "RG8": "RG8",
        "RG16": "RG16",
        "RG32F": "RG32F",
        "RGBA8": "RGBA8",
        "RGBA16": "RGBA16",
        "RGBA32F": "RGBA32F",
        "BC1": "BC1 (DXT1)",
        "BC2": "BC2 (DXT3)",
        "BC3": "BC3 (DXT5)",
        "BC4": "BC4 (ATI1)",
        "BC5": "BC5 (ATI2)",
        "BC6H": "BC6H (BPTC Float)",
        "BC7": "BC7 (BPTC)",
    },
    "type": {"Texture2D": "2D", "Texture3D": "3D", "TextureCube": "Cube"},
    "kind": {
        "Other": "Other",
        "Diffuse": "Diffuse",
        "Normal": "Normal",
        "Specular": "Specular",
        "Albedo": "Albedo",
        "Roughness": "Roughness",
        "Metalness": "Metalness",
        "AmbientOcclusion": "Ambient Occlusion",
        "Gloss": "Gloss",
        "Emissive": "Emissive",
        "AlphaMask": "Alpha Mask",
        "BinaryMask": "Binary Mask",
        "TransparencyMask": "Transparency Mask",
        "BlendMask": "Blend Mask",
        "Lightmap": "Lightmap",
        "EnvironmentPBR": "Environment (PBR)",
        "EnvironmentLegacy": "Environment (Legacy)",
        "Multikind": "Multi-Kind",
        "Unused": "Unused",
        "ORM": "ORM (Legacy)",
    },
    "blp_encoding": {
        0: "Infer (Auto)",
        1: "True Color (BGRA)",
        2: "Paletted (256 colors)",
        3: "JPEG",
        4: "BC1 (DXT1)",
        5: "BC2 (DXT3)",
        6: "BC3 (DXT5)",
    },
    "dds_format": {
        0: "True Color (RGBA8)",
        1: "BC1 (DXT1)",
        2: "BC2 (DXT3)",
        3: "BC3 (DXT5)",
        4: "BC4 (RGTC1)",
        5: "BC5 (RGTC2)",
        6: "BC6H (BPTC Float)",
        7: "BC7 (BPTC)",
        8: "BC3N (DXT5nm)",
    },
}

# --- fixed values: archive layout -----------------------------------------
TEXTURE_GROUP = "Texture"
PACKED_MAGIC = 0x44CF00F5
PACKED_ALIGNMENT = 8
HEADER_BYTES = 16
VIRTUAL_FOLDER = "Diablo IV Textures"

# --- fixed values: recent-item list length --------------------------------
MAX_RECENT = 10

# --- fixed values: messages -----------------------------------------------
TOO_SMALL = "Image too small to downscale"
UNSUPPORTED_INPUT = "Unsupported input format"
UNAVAILABLE = "Skipped (encrypted or unavailable): "
UNREADABLE = "Failed to read: "
LOST_PAYLOAD = "Failed to load D4 TEX: "
