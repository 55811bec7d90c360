"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK = "struct<text:string,x0:double,y0:double,x1:double,y1:double,page:int,type:string>"
PAGE = f"struct<page:int,width:int,height:int,blocks:array<{BLOCK}>>"
OCR_DOCUMENT = f"pages array<{PAGE}>"
TABLE_CELL = (
    "table_id string, cell_no int, text string, x0 double, x1 double, top double, bottom double, layout_type string, page_number int, "
    "R int, R_top double, R_bott double, H int, H_top double, H_bott double, H_left double, H_right double, C int, C_left double, C_right double, SP int"
)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L = T.StringType(), T.ArrayType(T.StringType())
# The names and order of an extraction's fields.
ADDRESS = _strings("tinh_thanh_pho", "quan_huyen", "xa_phuong", "dia_chi_chi_tiet")
PAPER = _strings("loai_giay_to", "so_giay_to", "ngay_cap", "ngay_het_han")
HEADER = _strings(
    "so_ban_an_quyet_dinh", "ngay_ban_hanh", "ngay_hieu_luc", "ten_don_vi_ban_hanh", "so_ban_an_lien_quan", "ngay_ban_hanh_lien_quan",
    "ngay_hieu_luc_lien_quan", "don_vi_ban_hanh_lien_quan", "trang_thai_ban_an", "ghi_chu",
)
CONVICTION = _struct(
    thong_tin_an_tich=_S, ten_toi_danh=_L, dieu_khoan_luat_ap_dung=_L, ten_hinh_phat_chinh=_S, thoi_han_gia_tri_hinh_phat_chinh=_S,
    ten_hinh_phat_bo_sung=_L, thoi_han_gia_tri_hinh_phat_bo_sung=_S, an_phi=_S, mien_phi=_S,
)
PERSON = _struct(
    ho_va_ten=_S, ten_goi_khac=_S, giay_to_dinh_danh=PAPER, gioi_tinh=_S, ngay_sinh=_S, noi_sinh=ADDRESS, quoc_tich=_S, dan_toc=_S, ton_giao=_S,
    noi_cu_tru=ADDRESS, noi_thuong_tru=ADDRESS, que_quan=ADDRESS, ho_ten_cha=_S, ho_ten_me=_S, ho_ten_vo_chong=_S,
)
FOREIGNER = _strings("so_dinh_danh", "loai_giay_to_xnc", "so_giay_to", "ho_ten", "quoc_tich", "ngay_sinh", "gioi_tinh")
LEGAL_ENTITY = _struct(
    loai_co_quan_to_chuc=_S, ten_co_quan_to_chuc=_S, so_gcn_dang_ky_doanh_nghiep=_S, ma_so_thue=_S, ho_ten_nguoi_dai_dien=_S, so_dinh_danh_nguoi_dai_dien=_S, dia_chi_tru_so=ADDRESS,
)
ENTITY = _struct(thong_tin_ket_an=CONVICTION, bi_cao_vn=PERSON, bi_cao_nuoc_ngoai=FOREIGNER, phap_nhan_pham_toi=LEGAL_ENTITY)
EXTRACTION = _struct(thong_tin_chung=HEADER, danh_sach_doi_tuong=T.ArrayType(ENTITY))
#: The lists of an extraction that are read as empty where they are null.
EMPTY_LISTS = ("ten_toi_danh", "dieu_khoan_luat_ap_dung", "ten_hinh_phat_bo_sung")
