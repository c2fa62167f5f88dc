"""Settings of colour reduction and of a whole conversion."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Moments of the assumed background colours (mean and mean square of y, i, q).
MEAN_YIQ = (217.74103083818213, -0.0000041426875938555, -0.0000076075821411337)
MEAN_SQUARE_YIQ = (58357.111277243079, 6772.8810438603696, 15832.570906234554)

ALPHA_NONE, ALPHA_RESERVE, ALPHA_PIXEL, ALPHA_PALETTE = "none", "reserve", "pixel", "palette"
MAX_COLORS, MAX_LAYERS = 256, 16


@dataclass(frozen=True)
class Reduction:
    """Weights of the colour distance and rules of palette creation; immutable, so it can be shipped to tasks."""

    balance: int = 20
    color_balance: int = 20
    enhance: bool = False
    alpha_mode: str = ALPHA_NONE
    alpha_threshold: int = 128
    mask15: bool = True
    rounds: int = 8
    mean: tuple[float, float, float] = MEAN_YIQ
    mean_square: tuple[float, float, float] = MEAN_SQUARE_YIQ

    def __post_init__(self) -> None:
        if not (1 <= self.balance <= 39 and 1 <= self.color_balance <= 39):
            raise ValueError("balances lie between 1 and 39")

    @property
    def weights(self) -> tuple[float, float, float]:
        return float(40 - self.balance), float(self.color_balance), float(40 - self.color_balance)

    @property
    def squares(self) -> tuple[float, float, float]:
        y, i, q = self.weights
        return y * y, i * i, q * q

    @property
    def alpha_square(self) -> float:
        return sum(m * w for m, w in zip(self.mean_square, self.squares, strict=True))

    @property
    def interaction(self) -> tuple[float, float, float]:
        y, i, q = (2 * m * w for m, w in zip(self.mean, self.squares, strict=True))
        return y, i, q

    def on_backgrounds(self, mean, mean_square) -> Reduction:
        """The same reduction for colours shown over backgrounds with these moments."""
        return replace(self, mean=tuple(mean), mean_square=tuple(mean_square))


@dataclass(frozen=True)
class EncodeOptions:
    """What the command line sets."""

    mode: str = "bg"
    output: str = "bin"
    base: str | None = None
    silent: bool = False
    verbose: bool = False
    alpha_key: int | None = None
    diffuse: float = 0.0
    balance: int = 20
    color_balance: int = 20
    enhance: bool = False
    max_colors: int | None = None
    codecs: tuple[str, ...] = ()
    vram_safe: bool = True
    bg_type: str = "affine_ext"
    palettes: int = 1
    palette_base: int = 0
    palette_offset: int = 0
    color0_opaque: bool = False
    max_chars: int | None = None
    merge_chars: bool = True
    screen: bool = True
    screen_only: bool = False
    char_base: int | None = None
    existing_palette: str | None = None
    existing_chars: str | None = None
    used_palettes_only: bool = False
    texture_format: str | None = None
    merge_threshold: int = 0
    fixed_palette: str | None = None
    output_fixed_palette: bool = False
    trim: bool = False
    color0_transparent: bool | None = None
    dither_alpha: bool = False
    inputs: tuple[str, ...] = field(default=())

    @property
    def reduction(self) -> Reduction:
        return Reduction(self.balance, self.color_balance, self.enhance)

    def checked(self) -> EncodeOptions:
        """With implied settings filled in; contradictory ones raise ValueError."""
        o = self
        if o.bg_type in ("text8", "affine", "bitmap"):
            o = replace(o, palettes=1)
        if o.bg_type == "affine":
            o = replace(o, max_chars=min(o.max_chars or 256, 256))
        if o.output == "grf" and not o.codecs:
            o = replace(o, codecs=("none",))
        limit = 16 if o.bg_type == "text4" else 256
        if o.mode == "bg":
            colors = o.max_colors if o.max_colors is not None else limit - o.palette_offset
            o = replace(o, max_colors=colors)
            if colors < 1 or o.palette_offset + colors > limit:
                raise ValueError(f"palette offset and colours exceed {limit}")
            if not 1 <= o.palettes <= 16 or o.palette_base + o.palettes > 16:
                raise ValueError("palettes exceed 16")
            if o.max_chars is None:
                o = replace(o, max_chars=1024)
            if not 1 <= o.max_chars <= 1024:
                raise ValueError("characters are limited to 1024")
            if o.screen_only and not (o.existing_palette and o.existing_chars):
                raise ValueError("screen only needs an existing palette and existing characters")
        elif o.output == "nns":
            raise ValueError("this output is for backgrounds only")
        if o.max_colors is not None and not 1 <= o.max_colors <= (0x8000 if o.mode == "texture" else 256):
            raise ValueError("too many colours")
        if not 0 <= o.diffuse <= 1 or not 0 <= o.merge_threshold <= 100:
            raise ValueError("percentages lie between 0 and 100")
        if len(o.inputs) > MAX_LAYERS:
            raise ValueError(f"at most {MAX_LAYERS} images")
        return o
