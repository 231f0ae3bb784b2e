"""colloquy.streaming"""
